"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.joins import tasks_for
from riskframe.session import shuffle_partitions, stage

LEAST = 100  # neighbours below which a node is never hot


def _handed(edges: DataFrame, low: DataFrame, limit: int, total: int) -> DataFrame:
    """``edges`` (u, v) with u's smallest neighbour m. Hot nodes, at most total / limit of them, are broadcast."""
    if total <= limit:
        return edges.join(low, "u")
    hot = F.broadcast(low.filter(F.col("deg") > limit))
    return edges.join(hot, "u").unionByName(edges.join(hot.select("u"), "u", "left_anti").join(low.filter(F.col("deg") <= limit), "u"))


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("deg"))


def _staged(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges, and their number and a sum of their hashes, read back from what was written.

    No ``Observation``: it leaves the session unfit to be sent, and with it every Spark ML model that keeps a summary.
    """
    e = stage(edges.filter("u <> v").distinct())
    return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the smallest node of its component.

    A round hands each node's larger neighbours to its smallest one, then its smaller ones, so a chain shrinks by half
    and a star is final. A round is one write; the number of rounds grows with the logarithm of the longest path, and
    ends when the edges no longer change. The neighbours of a node with very many stay where they are. Null nodes
    have no edges. A round takes as many tasks as its edges need, and few edges no shuffle.
    """
    e, now = _staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(f"`{a}` IS NOT NULL AND `{b}` IS NOT NULL"))
    parts = shuffle_partitions(edges.sparkSession)
    while now[0]:
        before = now
        tasks = tasks_for(now[0])
        limit = now[0] if tasks == 1 else max(LEAST, 2 * now[0] // parts)
        e = e.coalesce(tasks)
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = _smallest(e.unionByName(turned).coalesce(tasks)).withColumn("m", F.least("m", "u"))
        large = _handed(turned, low, limit, now[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _smallest(large)
        small = _handed(large, least, limit, now[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        e, now = _staged(small.coalesce(1) if tasks == 1 else small)
        if now == before:
            break
    return e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("root")))
