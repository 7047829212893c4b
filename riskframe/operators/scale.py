"""Scaling: population statistics at fit time, literal arithmetic at apply time."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, lit_array, value
from riskframe.operators.fitted import Fitted
from riskframe.operators.quantiles import even_quantiles, quantiles

KINDS = ("standard", "robust", "minmax", "quantile", "power")
LAMBDAS = [round(-2 + 0.1 * i, 1) for i in range(41)]
GRID = 1000  # reference quantiles


def fit_scale(df: DataFrame, cols: list[str], kind: str = "standard", accuracy: int | None = None, lambdas=None) -> Fitted:
    fit = {"standard": _fit_standard, "minmax": _fit_minmax}
    if kind in fit:
        return Fitted(kind, fit[kind](df, cols))
    if kind == "robust":
        qs = quantiles(df, cols, [0.25, 0.5, 0.75], accuracy)
        return Fitted(kind, {c: {"center": q[1], "scale": _nonzero(q[2] - q[0])} for c, q in qs.items()})
    if kind == "quantile":
        return Fitted(kind, _fit_quantile(df, cols, accuracy))
    if kind == "power":
        return Fitted(kind, _fit_power(df, cols, lambdas or LAMBDAS))
    raise ValueError(f"unknown scaler {kind!r}; one of {KINDS}")


def apply_scale(df: DataFrame, params: Fitted) -> DataFrame:
    if params.kind == "quantile":
        return _apply_quantile(df, params)
    if params.kind == "power":
        return df.withColumns({c: (yeo_johnson(F.col(c), p["lam"]) - d(p["center"])) / d(p["scale"]) for c, p in params.cols.items()})
    return df.withColumns({c: (F.col(c) - d(p["center"])) / d(p["scale"]) for c, p in params.cols.items()})


def _nonzero(x) -> float:
    return float(x) if x else 1.0


def _fit_standard(df, cols):
    row = df.agg(*[f(value(c)).alias(f"{a}_{c}") for c in cols for a, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: {"center": float(row[f"m_{c}"]), "scale": _nonzero(row[f"s_{c}"])} for c in cols}


def _fit_minmax(df, cols):
    row = df.agg(*[f(value(c)).alias(f"{a}_{c}") for c in cols for a, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: {"center": float(row[f"lo_{c}"]), "scale": _nonzero(row[f"hi_{c}"] - row[f"lo_{c}"])} for c in cols}


def _fit_quantile(df, cols, accuracy):
    """Exact at every size, unless the caller asks for a sketch of an ``accuracy``."""
    grids = quantiles(df, cols, [i / (GRID - 1) for i in range(GRID)], accuracy) if accuracy else even_quantiles(df, cols, GRID)
    out = {}
    for c, grid in grids.items():
        # equal grid values collapse to one knot with its first and last reference position
        knots: dict[float, list[float]] = {}
        for i, v in enumerate(grid):
            r = i / max(1, len(grid) - 1)
            if v is not None:
                knots.setdefault(v, [r, r])[1] = r
        out[c] = {"v": list(knots), "lo": [k[0] for k in knots.values()], "hi": [k[1] for k in knots.values()]}
    return {c: out[c] for c in cols}


def _apply_quantile(df, params):
    """Binary search for the knot below, then linear interpolation to [0, 1]; ties take the middle."""
    for c, p in params.cols.items():
        if len(p["v"]) < 2:
            df = df.withColumn(c, F.when(value(c).isNull(), F.lit(None)).otherwise(d(0)))
            continue
        df = Bucketizer(
            splits=[float("-inf"), *p["v"], float("inf")], inputCol=c, outputCol="__j", handleInvalid="keep"
        ).transform(df.withColumn(c, value(c)))
        j, last = F.col("__j").cast("int"), len(p["v"])
        at = lambda a, i: F.get(lit_array(p[a]), F.coalesce(i, F.lit(1)) - 1)
        lo, hi = F.greatest(j, F.lit(1)), F.least(j + 1, F.lit(last))
        v0, v1 = at("v", lo), at("v", hi)
        # get() and a clamp: branches of a null row are worked out too
        between = at("hi", lo) + (at("lo", hi) - at("hi", lo)) * (F.col(c) - v0) / (v1 - v0)
        df = df.withColumn(
            c,
            F.when(F.col(c).isNull(), F.lit(None))
            .when(j == 0, d(0))
            .when(F.col(c) == v0, (at("lo", lo) + at("hi", lo)) / d(2))
            .when(j >= last, d(1))
            .otherwise(between),
        ).drop("__j")
    return df


def yeo_johnson(x: Column, lam) -> Column:
    """Power transform with a number or a column as lambda."""
    lam = lam if isinstance(lam, Column) else d(lam)
    two = d(2) - lam
    pos = F.when(F.abs(lam) < d(1e-9), F.log1p(x)).otherwise((F.pow(x + d(1), lam) - d(1)) / lam)
    neg = F.when(F.abs(two) < d(1e-9), -F.log1p(-x)).otherwise(-(F.pow(d(1) - x, two) - d(1)) / two)
    return F.when(x >= d(0), pos).otherwise(neg)


def power_likelihood(df: DataFrame, cols: list[str], lambdas) -> DataFrame:
    """``(lam, <col> ...)``: log-likelihood of each lambda, every column in the same pass."""
    grid = df.select(*[value(c).alias(c) for c in cols], F.explode(lit_array(lambdas)).alias("lam"))
    sign = lambda c: F.signum(F.col(c)) * F.log1p(F.abs(F.col(c)))
    aggs = []
    for c in cols:
        var = F.var_pop(yeo_johnson(F.col(c), F.col("lam")))
        aggs.append((d(-0.5) * F.count(c) * F.log(var) + F.first(F.col("lam") - d(1)) * F.sum(sign(c))).alias(c))
    return grid.groupBy("lam").agg(*aggs)


def _yeo_johnson_slope(x: Column, lam: Column) -> Column:
    """Derivative of the power transform by lambda."""

    def by_power(base, t):
        # ((1 + base)^t - 1) / t by t; a series where t is almost 0
        log = F.log1p(base)
        p = F.pow(base + d(1), t)
        return F.when(F.abs(t) < d(1e-4), log * log / d(2) + t * log * log * log / d(3)).otherwise((p * log - (p - d(1)) / t) / t)

    return F.when(x >= d(0), by_power(x, lam)).otherwise(by_power(-x, d(2) - lam))


def likelihood_slopes(df: DataFrame, at: dict[str, float]) -> dict[str, float | None]:
    """Slope of each column's log-likelihood at its lambda, all columns in one pass; None where it cannot be told."""
    aggs = []
    for c, lam in at.items():
        y, slope = yeo_johnson(value(c), d(lam)), _yeo_johnson_slope(value(c), d(lam))
        bend = F.sum(F.signum(value(c)) * F.log1p(F.abs(value(c))))
        aggs.append((bend - F.count(value(c)) * F.covar_pop(y, slope) / F.nullif(F.var_pop(y), d(0))).alias(c))
    row = df.agg(*aggs).first()
    return {c: row[c] if row[c] is not None and math.isfinite(row[c]) else None for c in at}


def likelihood_lambdas(df: DataFrame, cols: list[str], tol: float = 1e-8) -> dict[str, float]:
    """Maximum-likelihood lambda per column: the root of the likelihood's slope, which falls with lambda.

    Brackets widen until the slope changes its sign, then shrink by false position with bisection, every column's next
    point in the same aggregate. A column without spread keeps its values (lambda 1).
    """
    ends = {c: [-2.0, 2.0] for c in cols}
    lo = likelihood_slopes(df, {c: -2.0 for c in cols})
    hi = likelihood_slopes(df, {c: 2.0 for c in cols})
    out = {c: 1.0 for c in cols if lo[c] is None or hi[c] is None}
    for side, slopes, wrong in ((0, lo, lambda v: v < 0), (1, hi, lambda v: v > 0)):
        while todo := {c: ends[c][side] * 2 for c in cols if c not in out and wrong(slopes[c])}:
            for c, v in likelihood_slopes(df, todo).items():
                if v is None:
                    out[c] = ends[c][side]  # beyond what doubles can tell
                else:
                    ends[c][side], slopes[c] = todo[c], v
    step = 0
    while todo := [c for c in cols if c not in out and ends[c][1] - ends[c][0] > tol]:
        at = {}
        for c in todo:
            a, b = ends[c]
            chord = a + (b - a) * lo[c] / (lo[c] - hi[c])
            # a hair beyond the chord, towards the end that is farther, so that both ends move
            chord += math.copysign(min(tol / 2, (b - a) / 4), (a + b) / 2 - chord)
            at[c] = chord if step % 3 < 2 and a < chord < b else (a + b) / 2
        for c, v in likelihood_slopes(df, at).items():
            if v is None or v == 0:
                out[c] = at[c]
            elif v > 0:
                ends[c][0], lo[c] = at[c], v
            else:
                ends[c][1], hi[c] = at[c], v
        step += 1
    return {c: out[c] if c in out else sum(ends[c]) / 2 for c in cols}


def _fit_power(df, cols, lambdas):
    """By a grid of lambdas, or with ``lambdas="likelihood"`` at the maximum of the likelihood."""
    if lambdas == "likelihood":
        best = likelihood_lambdas(df, cols)
    else:
        rows = power_likelihood(df, cols, lambdas).collect()  # one row per grid point
        best = {}
        for c in cols:
            ok = [(r[c], -r["lam"]) for r in rows if r[c] is not None and math.isfinite(r[c])]
            best[c] = -max(ok)[1] if ok else 1.0  # a constant column keeps its values
    row = df.agg(
        *[f(yeo_johnson(value(c), best[c])).alias(f"{a}_{c}") for c in cols for a, f in (("m", F.avg), ("s", F.stddev_pop))]
    ).first()
    return {c: {"lam": best[c], "center": float(row[f"m_{c}"]), "scale": _nonzero(row[f"s_{c}"])} for c in cols}
