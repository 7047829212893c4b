"""A join that spreads hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join on ``on`` with the rows of a hot left key dealt over ``salts`` tasks by ``by``; ``right`` is copied to each."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*([on] if isinstance(on, str) else on), "_salt"], how).drop("_salt")
