"""Feature selection from one-pass class statistics.

Every selector works on vector summaries (one map-side-combined aggregate, a row per class), then on
``(pos, score, selected)`` tables whose size is the number of features.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, safe_div
from riskframe.operators.profile import class_moments, moments, vector_summary

CHI2_CRITICAL = 3.841459  # fixed value: 95 % point of chi-square with one degree of freedom


def nonconstant(df: DataFrame, eps: float = 0.0, col: str = "features") -> DataFrame:
    return moments(df, col).select("pos", F.col("std").alias("score"), (F.col("std") > d(eps)).cast("int").alias("selected"))


def variance_mask(df: DataFrame, t: float = 0.0, col: str = "features") -> DataFrame:
    var = F.col("std") * F.col("std")
    return moments(df, col).select("pos", var.alias("score"), (var > d(t)).cast("int").alias("selected"))


def anova_f(df: DataFrame, label: str = "target", k: int | None = None, col: str = "features") -> DataFrame:
    """One-way F per feature; with ``k`` the k best are selected."""
    c = class_moments(df, label, col)
    n, m = F.col("n").cast("double"), F.col("mean")
    s = c.groupBy("pos").agg(
        F.sum(n).alias("whole"), F.count("*").alias("k"), F.sum(n * m).alias("t"), F.sum(n * m * m).alias("q"), F.sum(n * F.col("var")).alias("ssw")
    )
    ssb = F.col("q") - F.col("t") * F.col("t") / F.col("whole")
    f = safe_div(ssb / (F.col("k") - 1), F.col("ssw") / (F.col("whole") - F.col("k")))
    return top_k(s.select("pos", f.alias("score")), k) if k else s.select("pos", f.alias("score"), F.lit(1).alias("selected"))


def chi2_scores(df: DataFrame, label: str = "target", n: int = 5, col: str = "features") -> DataFrame:
    """Chi-square of uniform bin codes (sum of codes per class against class share), at 5 %.

    Falls back to all non-constant features when none is significant.
    """
    whole = vector_summary(df, (), col).first()
    lo, hi = whole["min"], whole["max"]
    step = F.array(*[d((b - a) / n) for a, b in zip(lo, hi)])
    low = F.array(*[d(a) for a in lo])
    code = F.zip_with(
        F.zip_with(F.col(col), low, lambda x, a: F.struct(x.alias("x"), a.alias("a"))),
        step,
        lambda z, s: F.when(s == 0, d(0)).otherwise(
            sum(((z["x"] >= z["a"] + d(i) * s).cast("double") for i in range(2, n)), (z["x"] >= z["a"] + s).cast("double"))
        ),
    )
    per = vector_summary(df.withColumn("__code", code), [label], "__code")
    rows = per.select(label, "n", F.posexplode("mean").alias("pos", "mean")).withColumn("obs", F.col("mean") * F.col("n"))
    tot = rows.groupBy("pos").agg(F.sum("obs").alias("total"), F.sum("n").alias("whole"))
    e = F.col("n") / F.col("whole") * F.col("total")
    stat = rows.join(tot, "pos").groupBy("pos").agg(
        F.sum(safe_div((F.col("obs") - e) * (F.col("obs") - e), e)).alias("score"), F.max("total").alias("total")
    )
    out = stat.select("pos", "score", (F.col("score") > d(CHI2_CRITICAL)).cast("int").alias("selected"))
    spread = F.array(*[F.lit(int(b > a)) for a, b in zip(lo, hi)])
    none = F.max("selected").over(Window.partitionBy(F.lit(0))) == 0  # one row per feature
    return out.withColumn("selected", F.when(none, F.get(spread, F.col("pos"))).otherwise(F.col("selected")))


def fisher_ratio(df: DataFrame, label: str = "target", t: float = 0.001, col: str = "features") -> DataFrame:
    """Squared distance of class means over the sum of class variances; two classes only."""
    classes = df.select(label).distinct().limit(3).collect()
    if len(classes) != 2:
        raise ValueError("the Fisher ratio needs exactly two classes")
    c = class_moments(df, label, col).groupBy("pos").agg(
        (F.max("mean") - F.min("mean")).alias("gap"), F.sum("var").alias("within")
    )
    s = safe_div(F.col("gap") * F.col("gap"), F.col("within"))
    return c.select("pos", s.alias("score")).withColumn("selected", (F.col("score") > d(t)).cast("int"))


def top_k(imp: DataFrame, k: int | None = None, fraction: float | None = None, min_mean: bool = False, score: str = "score") -> DataFrame:
    """Mark the ``k`` best, the best ``fraction``, or all at or above the mean; ties go to the lower position."""
    whole = Window.partitionBy(F.lit(0))  # one row per feature
    if min_mean:
        return imp.withColumn("selected", (F.col(score) >= F.avg(score).over(whole)).cast("int"))
    place = F.row_number().over(whole.orderBy(F.col(score).desc(), "pos"))
    cut = F.lit(k) if k is not None else F.greatest(F.lit(1), F.floor(F.count("*").over(whole) * d(fraction)))
    return imp.withColumn("selected", (place <= cut).cast("int"))


def rank_features(imp: DataFrame, score: str = "score") -> DataFrame:
    """Keep every feature, ordered by score: ``place`` 1 is the highest."""
    return imp.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), "pos")))


def selected_positions(mask: DataFrame) -> list[int]:
    return [r["pos"] for r in mask.filter("selected = 1").select("pos").orderBy("pos").collect()]
