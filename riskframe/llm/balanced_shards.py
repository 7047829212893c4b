"""Shards by balanced label propagation.

Documents with equal texts are linked. Row counts per shard stay exactly even throughout: the start deals rows out in
turn, and later moves are swaps. In each round every linked row looks at where the copies of its text are (one row per
text and shard, so a text with a third of all rows is still one small group) and offers to move to the shard that holds
most of them and still has other rows. For each ordered pair of shards the quota is the smaller of the offers one way
and what may go the other way: offers in return first, then rows without links, which lose nothing by moving. Accepted
rows of both directions trade places by rank.

The rank of a row in its offer (from, to) is a two-level count, so no shard or pair of shards meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import global_index
from riskframe.llm.graph import spread_join
from riskframe.session import shuffle_partitions, stage

ROUNDS = 6


def _ranked(df: DataFrame, keys: list[str], order: list[str], blocks: int) -> DataFrame:
    """``rank`` from 0 within the keys, in a fixed pseudo-random order, counted block by block."""
    df = df.withColumn("blk", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = df.groupBy(*keys, "blk").agg(F.count("*").alias("bn"))
    before = Window.partitionBy(*keys).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "blk", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bstart"))
    inside = Window.partitionBy(*keys, "blk").orderBy(*order)
    same: list[str] = [*keys, "blk"]
    return df.withColumn("bpos", F.row_number().over(inside) - 1).join(starts, same).withColumn("rank", F.col("bstart") + F.col("bpos")).drop("blk", "bpos", "bstart")


def _offers(linked: DataFrame, sizes: DataFrame) -> DataFrame:
    """Linked rows that gain by moving: (rid, grp, shard, target)."""
    held = linked.groupBy("grp", "shard").agg(F.count("*").alias("held"))
    room = held.join(F.broadcast(sizes), "shard").select("grp", "held", F.xxhash64("grp", "shard").alias("tie"), "shard", (F.col("held") < F.col("size")).alias("open"))
    places = room.groupBy("grp").agg(F.collect_list(F.struct("held", "tie", "shard", "open")).alias("places"))
    # one entry per shard at most; between equal holdings the rows go towards the higher tie, so two do not trade for ever
    best = F.array_max(F.filter("places", lambda p: p["open"] & (p["shard"] != F.col("shard"))))
    wish = room.join(places, "grp").withColumn("best", best)
    ahead = (F.col("best.held") > F.col("held")) | ((F.col("best.held") == F.col("held")) & (F.col("best.tie") > F.col("tie")))
    wish = wish.filter(ahead).select("grp", "shard", F.col("best.shard").alias("target"))
    return spread_join(linked, wish, ["grp", "shard"], F.col("rid"))


def _round(linked: DataFrame, free: DataFrame, shards: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    sizes = linked.select("shard").unionAll(free.select("shard")).groupBy("shard").agg(F.count("*").alias("size"))
    offers = stage(_offers(linked, sizes))
    out = offers.groupBy("shard", "target").agg(F.count("*").alias("n"))
    back = out.select(F.col("shard").alias("target"), F.col("target").alias("shard"), F.col("n").alias("back"))
    loose = free.groupBy("shard").agg(F.count("*").alias("loose"))
    # a shard's loose rows are shared out among the shards that send more to it than they get back
    need = out.join(back, ["shard", "target"], "left").fillna(0, ["back"]).withColumn("need", F.greatest(F.col("n") - F.col("back"), F.lit(0)))
    per = Window.partitionBy("target").orderBy("shard")
    quota = (
        need.join(loose.withColumnRenamed("shard", "target"), "target", "left")
        .fillna(0, ["loose"])
        .withColumn("wanted", F.coalesce(F.sum("need").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("fill", F.greatest(F.least("need", F.col("loose") - F.col("wanted")), F.lit(0)))
        .withColumn("quota", F.least("n", "back") + F.col("fill"))
        .select("shard", "target", "quota", "fill", "wanted")
    )
    quota = stage(quota)  # one row per pair of shards
    moved = (
        _ranked(offers, ["shard", "target"], ["rid"], blocks)
        .join(F.broadcast(quota.select("shard", "target", "quota")), ["shard", "target"])
        .filter("rank < quota")
        .select("rid", F.col("target").alias("to"))
    )
    linked = stage(linked.join(moved, "rid", "left").withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    # loose rows of shard t with ranks [wanted, wanted + fill) go to the shard that fills t
    spans = quota.filter("fill > 0").select(F.col("target").alias("shard"), F.col("shard").alias("to"), "wanted", (F.col("wanted") + F.col("fill")).alias("until"))
    places = spans.groupBy("shard").agg(F.collect_list(F.struct("wanted", "until", "to")).alias("spans"))
    hit = F.filter("spans", lambda x: (F.col("rank") >= x["wanted"]) & (F.col("rank") < x["until"]))
    free = stage(_ranked(free, ["shard"], ["rid"], blocks).join(F.broadcast(places), "shard", "left").withColumn("shard", F.coalesce(F.get(hit, 0)["to"], "shard")).select("rid", "grp", "shard"))
    return linked, free


def cut_edges(rows: DataFrame) -> DataFrame:
    """Pairs of equal texts, and those of them in different shards, counted from group sizes."""
    held = rows.groupBy("grp", "shard").agg(F.count("*").cast("double").alias("held"))
    per = held.groupBy("grp").agg(F.sum("held").alias("n"), F.sum(F.col("held") * F.col("held")).alias("sq"))
    return per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("edges"), F.sum((F.col("n") * F.col("n") - F.col("sq")) / 2).alias("cut"))


def assign(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(rid, key, size, text_crc32, grp, shard) for every row; shard counts are at most one apart.

    Null text counts as empty, of size 1. Repeated rows and null keys are rows of their own; fewer rows than shards
    leave the last shards empty; an empty table gives an empty result. Two rows are linked when their texts have one
    SHA-256 digest and one length.
    """
    blocks = shuffle_partitions(docs.sparkSession) * 4
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).cast("long").alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("grp"))
    # a hashed order, so that the first deal does not follow the ids
    rows = stage(global_index(rows, F.xxhash64("key", "grp"), F.col("key"), name="rid").withColumn("shard", (F.col("rid") % shards).cast("int")))
    many = rows.groupBy("grp").agg(F.count("*").alias("copies")).filter("copies > 1").select("grp")
    linked = stage(spread_join(rows.select("rid", "grp", "shard"), many, "grp", F.col("rid")).select("rid", "grp", "shard"))
    free = rows.select("rid", "grp", "shard").join(linked.select("rid"), "rid", "left_anti")
    free = stage(free)
    for _ in range(rounds):
        before = linked
        linked, free = _round(linked, free, shards, blocks)
        if linked.join(before.select("rid", F.col("shard").alias("was")), "rid").filter("shard <> was").isEmpty():
            break
    final = linked.select("rid", "shard").unionAll(free.select("rid", "shard"))
    return rows.drop("shard").join(final, "rid")


def balanced_shards(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS) -> DataFrame:
    """The assignment with a gapless slot per shard, in a hashed order."""
    blocks = shuffle_partitions(docs.sparkSession) * 4
    placed = stage(assign(docs, shards, rounds))
    slots: Column = F.col("rank").cast("long")
    return _ranked(placed, ["shard"], ["rid"], blocks).select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", slots.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
