"""Exact linear-interpolation quantiles by bracketing.

A single exact aggregate would hold every distinct value in one task. Here a mergeable sketch brackets each
wanted rank; the last pass counts what lies below and at the bracket's ends and reads only the values
strictly inside, whose number the sketch's error bounds. Two passes up to about 10^8 rows, two more for
every further factor of a thousand.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import lit_array, value
from riskframe.operators.ranking import running_totals
from riskframe.session import stage

SMALL = 200_000  # values held by one exact read
ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY  # bracket half-width as a share of the rows: twice the sketch error
SHARE = 2 * (MARGIN + 1.0 / ACCURACY)  # largest share of rows strictly inside a bracket
CHUNK = 60  # columns per aggregate


def quantiles(df: DataFrame, cols: dict[str, Column] | list[str], qs: list[float], accuracy: int | None = None, small: int = SMALL):
    """``{column: [value per q]}``; nulls and NaN are skipped. ``accuracy`` switches to one sketch pass."""
    exprs = {c: F.col(c) for c in cols} if not isinstance(cols, dict) else cols
    names = list(exprs)
    out: dict[str, list] = {}
    for i in range(0, len(names), CHUNK):
        part = {n: exprs[n] for n in names[i : i + CHUNK]}
        out.update(_sketch(df, part, qs, accuracy) if accuracy else _exact(df, part, qs, small))
    return out


def _sketch(df, exprs, qs, accuracy):
    row = df.agg(*[F.percentile_approx(value(c), lit_array(qs), accuracy).alias(n) for n, c in exprs.items()]).first()
    return {n: list(row[n]) if row[n] is not None else [None] * len(qs) for n in exprs}


def even_quantiles(df: DataFrame, cols: list[str], size: int, small: int = SMALL) -> dict[str, list]:
    """``size`` evenly spaced quantiles per column, from the minimum to the maximum, exact at every size.

    Values are folded to (column, value, count); running counts give each distinct value the ranks it covers, and only
    values next to a wanted rank, at most three per quantile, reach the driver.
    """
    counts = df.agg(*[F.count(value(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    n = {c: counts[f"n{i}"] for i, c in enumerate(cols)}
    out: dict[str, list] = {c: [] for c in cols}
    for k in sorted({v for v in n.values() if 0 < v <= small}):
        part = [c for c in cols if n[c] == k]
        out.update(quantiles(df, part, _even(min(size, k)), small=small))
    wide = [c for c in cols if n[c] > small]
    if not wide:
        return out
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), value(c).alias("v")) for i, c in enumerate(wide)]))
    folded = stage(df.select(pairs.alias("p")).select("p.*").filter("v IS NOT NULL").groupBy("col", "v").agg(F.count("*").alias("n")))
    ranks = running_totals(folded, "v", ["n"], ["col"])
    total = F.element_at(F.array(*[F.lit(n[c]) for c in wide]), F.col("col") + 1)
    step = (total - 1) / (size - 1)  # ranks between two quantiles
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    wanted = F.floor((last + 1.001) / step) >= F.ceil((first - 1.001) / step)
    held: dict[int, list] = {i: [] for i in range(len(wide))}
    for r in ranks.filter(wanted).select("col", "v", first.alias("lo"), last.alias("hi")).collect():
        held[r["col"]].append((r["lo"], r["hi"], r["v"]))
    for i, c in enumerate(wide):
        rows = sorted(held[i])
        starts = [r[0] for r in rows]

        def at(k: int) -> float:
            lo, hi, v = rows[bisect_right(starts, k) - 1]
            if not lo <= k <= hi:
                raise RuntimeError("a wanted rank is missing")
            return v

        for q in _even(size):
            h = _position(q, n[c])
            k = math.floor(h)
            v0 = at(k)
            out[c].append(v0 if h == k else v0 + (at(k + 1) - v0) * (h - k))
    return out


def _even(size: int) -> list[float]:
    return [i / max(1, size - 1) for i in range(size)]


def _probes(p: float) -> list[float]:
    return [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]


def _position(q: float, n: int) -> float:
    """0-based rank of quantile ``q``; a whole rank must not be missed by floating noise."""
    return round(q * (n - 1), 9)


def _by_rank(base: DataFrame, names: list[str], counts: list[int], qs: list[float]) -> dict[str, list]:
    """Interpolate between order statistics, which are data values: equal values give equal quantiles."""
    ranks, aggs = {}, []
    for i, n in enumerate(counts):
        if n:
            at = [_position(q, n) for q in qs]
            need = sorted({k for h in at for k in (math.floor(h), min(n - 1, math.ceil(h)))})
            ranks[i] = (at, {k: j for j, k in enumerate(need)}, n)
            shares = ",".join(repr((k + 0.5) / n) for k in need)
            aggs.append(F.expr(f"percentile_disc(cast(split('{shares}', ',') as array<double>)) within group (order by x{i})").alias(f"p{i}"))
    row = base.agg(*aggs).first() if aggs else {}
    out = {name: [None] * len(qs) for name in names}
    for i, (at, index, n) in ranks.items():
        for j, h in enumerate(at):
            k = math.floor(h)
            v0, v1 = row[f"p{i}"][index[k]], row[f"p{i}"][index[min(n - 1, math.ceil(h))]]
            out[names[i]][j] = v0 + (v1 - v0) * (h - k)
    return out


def _exact(df, exprs, qs, small):
    names = list(exprs)
    ids = range(len(names))
    base = df.select(*[value(exprs[n]).alias(f"x{i}") for i, n in enumerate(names)])
    probes = lit_array([p for q in qs for p in _probes(q)])
    row = base.agg(
        *[F.count(f"x{i}").alias(f"n{i}") for i in ids], *[F.percentile_approx(f"x{i}", probes, ACCURACY).alias(f"b{i}") for i in ids]
    ).first()
    if max(row[f"n{i}"] for i in ids) <= small:
        return _by_rank(base, names, [row[f"n{i}"] for i in ids], qs)

    state = {}  # (column, quantile) -> bracket [lo, hi] around 0-based rank k
    for i in ids:
        n = row[f"n{i}"]
        for j, q in enumerate(qs):
            if n:
                h = _position(q, n)
                lo, hi = row[f"b{i}"][2 * j : 2 * j + 2]
                state[i, j] = {"lo": lo, "hi": hi, "k": math.floor(h), "frac": h - math.floor(h), "inside": n * SHARE}
    wide = {k: s for k, s in state.items() if s["inside"] > small}
    while wide:
        wide = _narrow(base, wide, small)

    aggs = []
    for (i, j), s in state.items():
        c, lo, hi = F.col(f"x{i}"), F.lit(s["lo"]), F.lit(s["hi"])
        aggs += [
            F.count_if(c < lo).alias(f"below{i}_{j}"),
            F.count_if(c == lo).alias(f"lo{i}_{j}"),
            F.count_if(_inside(i, s)).alias(f"in{i}_{j}"),
            F.count_if((c == hi) & (c > lo)).alias(f"hi{i}_{j}"),
            F.min(F.when(c > hi, c)).alias(f"above{i}_{j}"),
        ]
    counts = base.agg(*aggs).first() if aggs else {}
    # only ranks strictly inside a bracket need its values; the filter leaves little more than those
    read = {}
    for (i, j), s in state.items():
        first = s["k"] - counts[f"below{i}_{j}"] - counts[f"lo{i}_{j}"]
        if first + 1 >= 0 and first < counts[f"in{i}_{j}"]:
            read[i, j] = s
    values = {}
    if read:
        some = F.lit(False)
        for (i, _), s in read.items():
            some = some | F.coalesce(_inside(i, s), F.lit(False))
        values = (
            base.filter(some)
            .agg(*[F.sort_array(F.collect_list(F.when(_inside(i, s), F.col(f"x{i}")))).alias(f"v{i}_{j}") for (i, j), s in read.items()])
            .first()
        )
    out = {n: [None] * len(qs) for n in names}
    for (i, j), s in state.items():

        def at(r):
            r -= counts[f"below{i}_{j}"]
            if r < 0:
                raise RuntimeError("quantile bracket lost its rank")
            for n, value in ((counts[f"lo{i}_{j}"], s["lo"]), (counts[f"in{i}_{j}"], None), (counts[f"hi{i}_{j}"], s["hi"])):
                if r < n:
                    return values[f"v{i}_{j}"][r] if value is None else value
                r -= n
            return counts[f"above{i}_{j}"]

        v0 = at(s["k"])
        out[names[i]][j] = v0 if s["frac"] == 0 else v0 + (at(s["k"] + 1) - v0) * s["frac"]
    return out


def _inside(i: int, s: dict):
    return (F.col(f"x{i}") > F.lit(s["lo"])) & (F.col(f"x{i}") < F.lit(s["hi"]))


def _narrow(base: DataFrame, wide: dict, small: int) -> dict:
    """One more bracketing round, looking only at values strictly inside the brackets.

    A rank that turns out to sit on a bracket end is resolved: the bracket closes on that value.
    """
    row = base.agg(
        *[F.count_if(F.col(f"x{i}") <= F.lit(s["lo"])).alias(f"upto{i}_{j}") for (i, j), s in wide.items()],
        *[F.count_if(_inside(i, s)).alias(f"n{i}_{j}") for (i, j), s in wide.items()],
    ).first()
    live = {}
    for (i, j), s in wide.items():
        r, n = s["k"] - row[f"upto{i}_{j}"], row[f"n{i}_{j}"]
        if r < 0:  # both wanted ranks lie at the lower end, or the upper one just above it
            s["hi"], s["inside"] = s["lo"], 0
        elif r >= n:
            s["lo"], s["inside"] = s["hi"], 0
        elif n > small:
            live[i, j] = (s, r / n, n)
    if not live:
        return {}
    row = base.agg(
        *[F.percentile_approx(F.when(_inside(i, s), F.col(f"x{i}")), lit_array(_probes(p)), ACCURACY).alias(f"b{i}_{j}") for (i, j), (s, p, _) in live.items()]
    ).first()
    nxt = {}
    for (i, j), (s, _, n) in live.items():
        s["lo"], s["hi"] = row[f"b{i}_{j}"]
        s["inside"] = n * SHARE
        if s["inside"] > small and s["lo"] < s["hi"]:
            nxt[i, j] = s
    return nxt
