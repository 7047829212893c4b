"""A join whose hot keys are counted first and kept out of the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.session import shuffle_partitions

LEAST = 1000  # rows of a key below which it is never hot
EACH = 100_000  # rows of a few numbers for one task


def tasks_for(rows: int) -> int:
    """How many tasks so many narrow rows are worth. After ``coalesce`` to it a small table costs no shuffle of as many
    files as the session has shuffle partitions, and a large one stays dealt out."""
    return max(1, -(-rows // EACH))


def hot_keys(left: DataFrame, on: list[str], total: int, least: int = LEAST) -> DataFrame | None:
    """Keys that more than twice a shuffle partition's share of the rows hold; half as many as partitions at most."""
    limit = max(least, 2 * total // shuffle_partitions(left.sparkSession))
    if total <= limit:
        return None
    return left.groupBy(*on).agg(F.count("*").alias("__n")).filter(F.col("__n") > limit).select(*on)


def hot_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", least: int = LEAST) -> DataFrame:
    """``left.join(right, on, how)`` for inner and left joins where a few keys of ``left`` may hold most of its rows.

    The rows of a hot key meet a broadcast of the right rows of hot keys, so they stay where they are; all others are
    shuffled as usual. The broadcast holds the right rows of at most half as many keys as there are shuffle partitions,
    so ``right`` should have few rows a key (a dictionary, a table of ids). Rows with a null key are not shuffled
    either. ``left`` is read twice: pass a staged table where it is costly.
    """
    on = [on] if isinstance(on, str) else on
    if how not in ("inner", "left"):
        raise ValueError(f"no hot join of kind {how!r}")
    hot = hot_keys(left, on, left.count(), least)
    if hot is None:
        return left.join(right, on, how)
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in on)
    rest = left.filter(known)
    met = rest.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how)
    out = met.unionByName(rest.join(F.broadcast(hot), on, "left_anti").join(right, on, how))
    if how == "left":
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in on]
        out = out.unionByName(left.filter(f"NOT ({known})").select(*out.columns[: len(left.columns)], *blank))
    return out
