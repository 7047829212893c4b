"""Global order without a single-task window.

Three building blocks used by the splits, samplers, curves and dictionaries:

* ``hash_cut``        the m smallest rows per class by key hash, as a plain filter (radix selection);
* ``ranked``          exact 1..n row numbers per class in key-hash order;
* ``running_totals``  inclusive cumulative sums along any ordered column.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import hash_hex
from riskframe.session import shuffle_partitions

STEP = 3  # hex digits per radix round: 4096 counters per class reach the driver
DIGITS = 32  # hex digits of a hash
TAKE = 20_000  # a radix bucket this small is fetched and cut exactly


def hash_cut(df: DataFrame, by: str, quotas: dict, hashed: Column) -> Column:
    """Filter condition that keeps exactly ``quotas[c]`` rows of each class ``c``, smallest hash first.

    Each round counts one more run of hex digits inside the bucket where the quota falls, so no row is
    sorted or shuffled beyond the counters, and the result is a narrow filter on the input. Rows that share a hash are
    told apart by a hash of all their columns, which is looked at only where a quota falls among them; rows equal in
    every column are kept or left together, by the nearer of the two counts.
    """
    base = df.select(F.col(by).alias("c"), hashed.alias("h"))
    totals = {r["c"]: r["n"] for r in base.groupBy("c").agg(F.count("*").alias("n")).collect()}
    asked = {c: (max(0, int(quotas.get(c, 0))), n) for c, n in totals.items()}
    cuts, ties = _cuts(base, asked)
    keep = F.lit(False)
    for c, cut in cuts.items():
        if cut:
            keep = keep | ((F.col(by) == F.lit(c)) & (hashed <= F.lit(cut)))
    if not ties:
        return keep
    whole = hash_hex("row", F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    cond = F.lit(False)
    for c, (h, _, _) in ties.items():
        cond = cond | ((F.col(by) == F.lit(c)) & (hashed == F.lit(h)))
    second, equal = _cuts(df.filter(cond).select(F.col(by).alias("c"), whole.alias("h")), {c: (m, n) for c, (_, m, n) in ties.items()})
    for c, (h, _, _) in ties.items():
        mine, limit = F.col(by) == F.lit(c), second.get(c)
        if c in equal:
            limit, m, n = equal[c]
            inside = whole <= F.lit(limit) if 2 * m >= n else whole < F.lit(limit)
        else:
            inside = whole <= F.lit(limit)
        keep = keep | (mine & ((hashed < F.lit(h)) | ((hashed == F.lit(h)) & inside)))
    return keep


def _cuts(base: DataFrame, asked: dict) -> tuple[dict, dict]:
    """Per class the largest hash to keep; and where the quota falls among rows of one hash: (hash, quota left, rows)."""
    cuts: dict = {}
    ties: dict = {}
    todo = {}
    for c, (m, n) in asked.items():
        if m >= n:
            cuts[c] = "g"  # beyond every hex digest
        elif m == 0:
            cuts[c] = ""
        else:
            todo[c] = ("", m, n)
    while todo:
        for c, (prefix, m, n) in [(c, v) for c, v in todo.items() if v[2] <= TAKE]:
            rows = base.filter((F.col("c") == F.lit(c)) & F.col("h").startswith(prefix)).select("h").collect()
            hashes = sorted(r["h"] for r in rows)
            cut = hashes[m - 1]
            if m < n and hashes[m] == cut:
                first = hashes.index(cut)
                ties[c] = (cut, m - first, hashes.count(cut))
            else:
                cuts[c] = cut
            del todo[c]
        if not todo:
            break
        depth = len(next(iter(todo.values()))[0])
        cond = F.lit(False)
        for c, (prefix, _, _) in todo.items():
            cond = cond | ((F.col("c") == F.lit(c)) & F.col("h").startswith(prefix))
        counts = (
            base.filter(cond)
            .groupBy("c", F.substring("h", depth + 1, STEP).alias("p"))
            .agg(F.count("*").alias("n"))
            .collect()
        )
        nxt = {}
        for c, (prefix, m, _) in todo.items():
            for r in sorted((r for r in counts if r["c"] == c), key=lambda r: r["p"]):
                if m <= r["n"]:
                    if len(r["p"]) < STEP or len(prefix) + STEP >= DIGITS:  # the whole hash
                        if m == r["n"]:
                            cuts[c] = prefix + r["p"]
                        else:
                            ties[c] = (prefix + r["p"], m, r["n"])
                    else:
                        nxt[c] = (prefix + r["p"], m, r["n"])
                    break
                m -= r["n"]
        todo = nxt
    return cuts, ties


def ranked(df: DataFrame, hashed: Column, by: tuple | list = (), out: str = "rank", digits: int | None = None) -> DataFrame:
    """Exact row numbers 1..n per ``by`` in hash order: numbered inside hash buckets, then shifted.

    The number of buckets follows the shuffle partitions, at least 4,096.
    """
    by = list(by)
    digits = digits or max(3, math.ceil(math.log(64 * shuffle_partitions(df.sparkSession), 16)))
    d = df.withColumn("__h", hashed).withColumn("__b", F.substring("__h", 1, digits))
    per = d.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(
        F.sum("__n").over(
            Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    # at most 16^digits rows per class; with classes their number is open, so Spark picks the join
    offsets = per.select(*by, "__b", before.alias("__off"))
    if not by:
        offsets = F.broadcast(offsets)
    inner = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h"))
    return (
        d.withColumn("__i", inner)
        .join(offsets, [*by, "__b"])
        .withColumn(out, (F.col("__i") + F.col("__off")).cast("bigint"))
        .drop("__h", "__b", "__i", "__off")
    )


def cut_points(df: DataFrame, col: str, parts: int) -> list:
    """Range boundaries from a bounded, deterministic sample (the smallest hashes of the values)."""
    size = min(1 << 20, max(4096, 64 * parts))  # 64 values a range
    rows = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull()).orderBy(F.xxhash64("v")).limit(size).collect()
    vals = sorted({r["v"] for r in rows})
    if len(vals) < 2 or parts < 2:
        return []
    return sorted({vals[len(vals) * i // parts] for i in range(1, parts)})


def range_bucket(df: DataFrame, col: str, cuts: list, out: str) -> DataFrame:
    """Bucket number = how many cut points are <= value."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    if isinstance(df.schema[col].dataType, T.StringType):
        points = F.array(*[F.lit(c) for c in cuts])
        return df.withColumn(out, F.size(F.filter(points, lambda s: s <= F.col(col))))
    splits = [float("-inf"), *[float(c) for c in cuts], float("inf")]
    return (
        Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep")
        .transform(df)
        .withColumn(out, F.col(out).cast("int"))
    )


def running_totals(
    df: DataFrame, order: str, sums: list[str], by: tuple | list = (), descending: bool = False, parts: int | None = None
) -> DataFrame:
    """Add ``cum_<s>``: inclusive running sum of each ``s`` along ``order`` within ``by``.

    ``order`` holds each value once per group (aggregate first), so a value shared by a third of all
    rows is one row here. Ranges are summed independently; only the range totals are scanned in order.
    """
    by = list(by)
    parts = parts or 4 * shuffle_partitions(df.sparkSession)
    b = range_bucket(df, order, cut_points(df, order, parts), "__b")
    key = F.col("__b").desc() if descending else F.col("__b").asc()
    line = F.col(order).desc() if descending else F.col(order).asc()
    prior = Window.partitionBy(*(by or [F.lit(0)])).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    per = b.groupBy(*by, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    # one row per range, and per group when there are any: then Spark picks the join
    offsets = per.select(*by, "__b", *[F.coalesce(F.sum(f"__t_{s}").over(prior), F.lit(0)).alias(f"__o_{s}") for s in sums])
    if not by:
        offsets = F.broadcast(offsets)
    inner = Window.partitionBy(*by, "__b").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    out = b
    for s in sums:
        out = out.withColumn(f"__i_{s}", F.sum(s).over(inner))
    out = out.join(offsets, [*by, "__b"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"__i_{s}") + F.col(f"__o_{s}"))
    return out.drop("__b", *[f"__i_{s}" for s in sums], *[f"__o_{s}" for s in sums])
