"""Column expressions: key hashing, array arithmetic, small helpers. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def r6(c: Column | str) -> Column:
    """Six decimals: floating sums depend on partitioning, so results are compared rounded."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def d(x) -> Column:
    """Literal double (a bare literal would become a decimal in SQL text)."""
    return F.lit(float(x))


def value(c: Column | str) -> Column:
    """A number as double; NaN counts as missing, like null."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def missing(df: DataFrame, c: str) -> Column:
    """Whether a cell is null, or NaN in a floating column."""
    floating = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def hash_hex(*parts) -> Column:
    """md5 of the parts joined by '|'. Every pick, gap and shuffle is ordered by such a key hash."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def hex_int(h: Column) -> Column:
    """First 32 bits of a hex digest as bigint."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def hash_int(*parts) -> Column:
    return hex_int(hash_hex(*parts))


def hash_unit(*parts) -> Column:
    """Uniform number in [0, 1)."""
    return hash_int(*parts).cast("double") / d(2**32)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, d(0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, d(0), lambda acc, x: acc + x * x))


def lit_array(values) -> Column:
    """Constant double array; long ones as one foldable text literal instead of a literal per element."""
    if len(values) <= 32:
        return F.array(*[d(v) for v in values])
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, d(0)).otherwise(a.cast("double") / b.cast("double"))
