"""Profiling: nulls, classes, moments, quantiles, importance tiers, shape."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, missing, value
from riskframe.operators.quantiles import quantiles as exact_quantiles


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, nulls)`` from one pass; NaN counts as null."""
    one = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "nulls")


def class_counts(df: DataFrame, label: str = "target") -> DataFrame:
    """Rows and share per class. The handful of class rows is totalled in a window over the counts."""
    from pyspark.sql import Window

    per = df.groupBy(label).agg(F.count("*").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def vector_summary(df: DataFrame, by: tuple | list = (), col: str = "features") -> DataFrame:
    """n, mean, population variance per position, arrays out; one map-side-combined aggregate, no explode."""
    v = df.withColumn("__v", array_to_vector(F.col(col)))
    s = Summarizer.metrics("count", "mean", "variance", "min", "max").summary(F.col("__v")).alias("s")
    agg = v.groupBy(*by).agg(s) if by else v.agg(s)
    n = F.col("s.count").cast("double")
    return agg.select(
        *by,
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda x: x * (n - 1) / n).alias("var"),
        vector_to_array("s.min").alias("min"),
        vector_to_array("s.max").alias("max"),
    )


def _long(df: DataFrame, by, arrays: list[str]) -> DataFrame:
    """Summary arrays (one row per class) to one row per position."""
    z = df.select(*by, "n", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z"))
    return z.select(*by, "n", "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


def moments(df: DataFrame, col: str = "features") -> DataFrame:
    """``(pos, n, mean, std)``, population std."""
    return _long(vector_summary(df, (), col), (), ["mean", "var"]).select("pos", "n", "mean", F.sqrt("var").alias("std"))


def class_moments(df: DataFrame, label: str = "target", col: str = "features") -> DataFrame:
    """``(label, pos, n, mean, var)``, population variance."""
    return _long(vector_summary(df, [label], col), [label], ["mean", "var"])


def describe_cols(df: DataFrame, cols: list[str], accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max; one row per column. NaN counts as missing."""
    row = df.agg(
        *[
            f(value(c)).alias(f"{a}_{c}")
            for c in cols
            for a, f in (("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    ).first()
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy)
    flt = lambda x: None if x is None else float(x)
    rows = [
        (c, row[f"count_{c}"], flt(row[f"mean_{c}"]), flt(row[f"std_{c}"]), flt(row[f"min_{c}"]), *qs[c], flt(row[f"max_{c}"])) for c in cols
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, q75 double, max double"
    )


def quantiles(df: DataFrame, cols, qs: list[float], accuracy: int | None = None) -> DataFrame:
    """``(column, q, value)``."""
    vals = exact_quantiles(df, cols, qs, accuracy)
    rows = [(c, float(q), v) for c, vs in vals.items() for q, v in zip(qs, vs)]
    return df.sparkSession.createDataFrame(rows, "column string, q double, value double")


def importance_tier(imp: DataFrame, score: str = "importance") -> DataFrame:
    """Scale factor per feature: above the 80 % quantile .05, above the median .1, else .2."""
    q50, q80 = exact_quantiles(imp, [score], [0.5, 0.8])[score]
    return imp.withColumn("scale", F.when(F.col(score) > d(q80), d(0.05)).when(F.col(score) > d(q50), d(0.1)).otherwise(d(0.2)))


def shape(df: DataFrame, col: str | None = None) -> DataFrame:
    """Row and feature count; ``col`` names an array column."""
    width = F.max(F.size(col)) if col else F.lit(len(df.columns))
    return df.agg(F.count("*").alias("n_rows"), width.cast("bigint").alias("n_features"))
