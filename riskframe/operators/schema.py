"""Projection, schema alignment and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.exprs import d, value
from riskframe.operators.quantiles import quantiles


def drop_key(df: DataFrame, key: str = "company_id") -> DataFrame:
    return df.drop(key)


def split_xy(df: DataFrame, label: str = "target") -> tuple[DataFrame, str]:
    """Features in schema order with the label last; label and features stay in one row."""
    if label not in df.columns:
        raise ValueError(f"label column {label!r} is missing")
    return df.select(*[c for c in df.columns if c != label], label), label


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def string_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def align(df: DataFrame, cols: list[str], fill: float = 0.0, keep=()) -> DataFrame:
    """Fit-time column list: missing columns become ``fill``, extra ones go, order is restored."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else d(fill).alias(c) for c in cols])


def schema_diff(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Names only in ``a`` (missing from ``b``) and only in ``b`` (extra)."""
    a, b = a.select(name).distinct(), b.select(name).distinct()
    return a.join(b, name, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        b.join(a, name, "left_anti").withColumn("side", F.lit("extra"))
    )


def pad_or_truncate(c: Column, n: int) -> Column:
    return F.slice(F.concat(c, F.array_repeat(d(0), n)), 1, n)


def sort_columns(df: DataFrame, keep=()) -> DataFrame:
    """Feature columns in lexicographic name order (``_10`` before ``_2``)."""
    return df.select(*keep, *sorted(c for c in df.columns if c not in set(keep)))


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Named columns (numbers or arrays) into one dense array column, in the given order."""
    types = {f.name: f.dataType for f in df.schema}
    parts = [F.col(c) if isinstance(types[c], T.ArrayType) else F.array(F.col(c).cast("double")) for c in cols]
    if not any(isinstance(types[c], T.ArrayType) for c in cols):
        return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in cols]))
    return df.withColumn(out, F.concat(*parts))


def drop_null_label(df: DataFrame, label: str = "target") -> DataFrame:
    return df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double")))


def class_rows(df: DataFrame, label: str, v) -> DataFrame:
    return df.filter(F.col(label) == F.lit(v))


def uncertain_rows(df: DataFrame, p: str, lo: float = 0.3, hi: float = 0.7) -> DataFrame:
    return df.filter((F.col(p) > d(lo)) & (F.col(p) < d(hi)))


def hard_rows(df: DataFrame, p: str, label: str, t: float = 0.5) -> DataFrame:
    return df.filter((F.col(p) >= d(t)).cast("int") != F.col(label))


def outliers_z(df: DataFrame, cols: list[str], k: float = 2.5) -> DataFrame:
    """Rows with any |z| > k (population sigma). A constant column, or one holding a null or NaN, flags nothing."""
    row = df.agg(
        F.count("*").alias("n"),
        *[f(value(c)).alias(f"{a}_{c}") for c in cols for a, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    flag = F.lit(False)
    for c in cols:
        if row[f"n_{c}"] == row["n"] and row[f"s_{c}"]:
            flag = flag | (F.abs((F.col(c) - d(row[f"m_{c}"])) / d(row[f"s_{c}"])) > d(k))
    return df.filter(flag)


def outliers_iqr(df: DataFrame, cols: list[str], k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    """Rows with any value outside [Q1 - k IQR, Q3 + k IQR], linear-interpolation quartiles."""
    qs = quantiles(df, cols, [0.25, 0.75], accuracy)
    flag = F.lit(False)
    for c in cols:
        q1, q3 = qs[c]
        if q1 is not None:
            flag = flag | F.coalesce((value(c) < d(q1 - k * (q3 - q1))) | (value(c) > d(q3 + k * (q3 - q1))), F.lit(False))
    return df.filter(flag)


def slice_features(df: DataFrame, idx: list[int], col: str = "features") -> DataFrame:
    """Keep the positions ``idx`` (0-based, in the given order); a boolean mask works too."""
    if idx and all(isinstance(i, bool) for i in idx):
        idx = [i for i, keep in enumerate(idx) if keep]
    return df.withColumn(col, F.transform(F.array(*[F.lit(int(i)) for i in idx]), lambda i: F.get(F.col(col), i)))


def ratio_flag(df: DataFrame, num: str, den: str, flag_col: str, cut: float, ratio: str = "ratio", flag: str = "flag") -> DataFrame:
    return df.withColumn(ratio, F.col(num) / (F.col(den) + d(1))).withColumn(flag, (F.col(flag_col) >= d(cut)).cast("int"))
