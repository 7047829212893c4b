"""Feature construction on the array form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import array_sum, d, lit_array, safe_div
from riskframe.operators.profile import vector_summary

ROW_STATS = ["row_mean", "row_std", "row_max", "row_min", "row_median", "row_skew", "row_kurtosis", "row_q25", "row_q75", "row_cv"]


def _central(c: Column, mean: Column, p: int) -> Column:
    return array_sum(F.transform(c, lambda x: F.pow(x - mean, d(p))))


def array_quantile(sorted_arr: Column, q: float) -> Column:
    """Linear-interpolation quantile of an already sorted array."""
    h = d(q) * (F.size(sorted_arr) - F.lit(1))
    lo = F.floor(h).cast("int")
    v0 = F.get(sorted_arr, lo)
    v1 = F.get(sorted_arr, F.least(lo + 1, F.size(sorted_arr) - 1))
    return v0 + (v1 - v0) * (h - lo)


def row_stats(df: DataFrame, col: str = "features") -> DataFrame:
    """Ten statistics per row: moments are population, kurtosis is excess, cv = std / (mean + 1e-8)."""
    c = F.col(col)
    n = F.size(c).cast("double")
    out = df.withColumns({"__s": F.array_sort(c), "row_mean": array_sum(c) / n})
    m = F.col("row_mean")
    out = out.withColumns({f"__m{p}": _central(c, m, p) / n for p in (2, 3, 4)})
    m2 = F.col("__m2")
    out = out.withColumns(
        {
            "row_std": F.sqrt(m2),
            "row_max": F.array_max(c),
            "row_min": F.array_min(c),
            "row_median": array_quantile(F.col("__s"), 0.5),
            "row_skew": safe_div(F.col("__m3"), F.pow(m2, d(1.5))),
            "row_kurtosis": F.when(m2 == 0, d(0)).otherwise(F.col("__m4") / (m2 * m2) - d(3)),
            "row_q25": array_quantile(F.col("__s"), 0.25),
            "row_q75": array_quantile(F.col("__s"), 0.75),
            "row_cv": F.sqrt(m2) / (m + d(1e-8)),
        }
    )
    return out.drop("__s", "__m2", "__m3", "__m4")


def coarse_stats(df: DataFrame, col: str = "features", out: str = "coarse") -> DataFrame:
    """mean, std, median, max, min per row; zeros unless the row is wider than ten."""
    c = F.col(col)
    n = F.size(c).cast("double")
    mean = array_sum(c) / n
    s = df.withColumns({"__mean": mean, "__sorted": F.array_sort(c)})
    std = F.sqrt(_central(c, F.col("__mean"), 2) / n)
    stats = F.array(F.col("__mean"), std, array_quantile(F.col("__sorted"), 0.5), F.array_max(c), F.array_min(c))
    return s.withColumn(out, F.when(F.size(c) > 10, stats).otherwise(F.array_repeat(d(0), 5))).drop("__mean", "__sorted")


def fine_features(df: DataFrame, n: int = 10, col: str = "features", out: str = "fine") -> DataFrame:
    """First ``n`` columns; zeros unless the row is wider than ten."""
    c = F.col(col)
    return df.withColumn(out, F.when(F.size(c) > 10, F.slice(c, 1, n)).otherwise(F.array_repeat(d(0), n)))


def fit_var_fusion(df: DataFrame, a: str, b: str) -> dict[str, list[float]]:
    """Weights per block: population variance + 1e-8, normalised to sum one."""
    out = {}
    for c in (a, b):
        w = [v + 1e-8 for v in vector_summary(df, (), c).first()["var"]]
        out[c] = [x / sum(w) for x in w]
    return out


def apply_var_fusion(df: DataFrame, weights: dict[str, list[float]], out: str = "fused") -> DataFrame:
    return df.withColumn(out, F.concat(*[F.zip_with(F.col(c), lit_array(w), lambda x, y: x * y) for c, w in weights.items()]))


def interaction_pairs(importance: list[float], top: float = 0.2) -> list[tuple[int, int]]:
    """Pairs among the max(2, floor(top * d)) most important positions, in position order."""
    k = max(2, int(len(importance) * top))
    best = sorted(sorted(range(len(importance)), key=lambda i: (-importance[i], i))[:k])
    return [(best[i], best[j]) for i in range(len(best)) for j in range(i + 1, len(best))]


def products(df: DataFrame, pairs: list[tuple[int, int]], col: str, out: str) -> DataFrame:
    lit = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    return df.withColumn(out, F.transform(lit, lambda p: F.get(F.col(col), p["i"]) * F.get(F.col(col), p["j"])))


def interactions(df: DataFrame, importance: list[float], top: float = 0.2, col: str = "features", out: str = "interactions"):
    """Products of all pairs of the most important features; returns the frame and the names ``a_x_b``."""
    pairs = interaction_pairs(importance, top)
    return products(df, pairs, col, out), [f"{i}_x_{j}" for i, j in pairs]


def crosses(df: DataFrame, width: int, col: str = "features", out: str = "crosses") -> DataFrame:
    """Degree-2 crosses without squares or bias: the originals, then every pair product."""
    pairs = [(i, j) for i in range(width) for j in range(i + 1, width)]
    return products(df, pairs, col, "__x").withColumn(out, F.concat(F.col(col), "__x")).drop("__x")
