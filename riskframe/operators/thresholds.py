"""Decision thresholds from the PR curve or from a fixed grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, safe_div, value
from riskframe.operators.metrics import class_totals, curve_counts
from riskframe.operators.ranking import range_bucket

# Search grids (start, step, points)
GRIDS = {
    "gmean": (0.1, 0.01, 80),
    "cost": (0.2, 0.006, 101),
    "youden": (0.0, 0.01, 101),
    "fbeta": (0.0, 0.01, 101),
}
EPS = 1e-8


def grid_points(start: float, step: float, n: int) -> list[float]:
    return [start + i * step for i in range(n)]


def _pr_points(df, label, p):
    pos, _ = class_totals(df, label)
    return curve_counts(df, label, p).select(
        "threshold", safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe_div(F.col("tp"), F.lit(pos)).alias("recall")
    )


def best_f1_threshold(df: DataFrame, label: str, p: str) -> DataFrame:
    """Threshold with the highest 2PR / (P + R + 1e-8); the lowest one on ties. A plain two-level maximum."""
    prec, rec = F.col("precision"), F.col("recall")
    pts = _pr_points(df, label, p).withColumn("f1", d(2) * prec * rec / (prec + rec + d(EPS)))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return pts.agg(best.alias("b")).select("b.*")


def max_recall_threshold(df: DataFrame, label: str, p: str, min_precision: float = 0.4) -> DataFrame:
    """Highest recall with precision >= ``min_precision`` (lowest threshold on ties); none gives .5."""
    pts = _pr_points(df, label, p).filter(F.col("precision") >= d(min_precision))
    best = F.max_by(F.struct("threshold", "precision", "recall"), F.struct(F.col("recall"), -F.col("threshold")))
    return pts.agg(best.alias("b")).select(F.coalesce("b.threshold", d(0.5)).alias("threshold"), "b.precision", "b.recall")


def grid_counts(df: DataFrame, label: str, p: str, grid: list[float]) -> list[tuple]:
    """``(threshold, tp, fp, fn, tn)`` per grid point from one pass: every score falls into one grid cell,
    and only the cell counts (one per grid point) are accumulated. Rows without a label are left out; a row without a
    score is predicted negative at every threshold."""
    y = F.col(label).cast("bigint")
    df = df.filter(F.col(label).isNotNull())
    cells = (
        range_bucket(df.select(y.alias("y"), F.coalesce(value(p), d(float("-inf"))).alias("p")), "p", list(grid), "cell")
        .groupBy("cell")
        .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
        .collect()
    )
    pos, neg = [0] * (len(grid) + 1), [0] * (len(grid) + 1)
    for r in cells:
        pos[r["cell"]], neg[r["cell"]] = r["pos"], r["neg"]
    out, tp, fp = [], sum(pos), sum(neg)
    n_pos, n_neg = tp, fp
    for i, t in enumerate(grid):
        tp, fp = tp - pos[i], fp - neg[i]
        out.append((t, tp, fp, n_pos - tp, n_neg - fp))
    return out


def _ratio(a, b):
    return a / b if b else 0.0


def objective_value(kind: str, tp, fp, fn, tn, w: dict) -> float:
    p, r, s = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    if kind == "gmean":
        return math.sqrt(r * p)
    if kind == "cost":
        return w.get("recall", 2.0) * r + w.get("precision", 1.5) * p - w.get("specificity", 0.5) * (1 - s)
    if kind == "youden":
        return tp / (tp + fn + EPS) + tn / (tn + fp + EPS) - 1
    if kind == "fbeta":
        b2 = w.get("beta", 1.2) ** 2
        return _ratio((1 + b2) * p * r, b2 * p + r)
    raise ValueError(f"unknown objective {kind!r}")


# A grid point must beat this to replace the default threshold .5
FLOOR = {"gmean": 0.0, "cost": -math.inf, "youden": -1.0, "fbeta": -1.0}


def grid_threshold(df: DataFrame, label: str, p: str, grid: list[float] | None = None, objective: str = "gmean", **w) -> DataFrame:
    """First grid point with the highest objective: ``(threshold, score, tp, fp, fn, tn)``."""
    grid = grid or grid_points(*GRIDS[objective])
    best, score = None, FLOOR[objective]
    for row in grid_counts(df, label, p, grid):
        v = objective_value(objective, *row[1:], w)
        if v > score:
            best, score = row, v
    out = (*best[:1], score, *best[1:]) if best else (0.5, None, None, None, None, None)
    return df.sparkSession.createDataFrame([out], "threshold double, score double, tp bigint, fp bigint, fn bigint, tn bigint")


def apply_threshold(df: DataFrame, p: str, t: float, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, (F.col(p) >= d(t)).cast("int"))
