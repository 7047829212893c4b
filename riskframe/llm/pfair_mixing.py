"""Mixing sources to target weights by a Pfair schedule.

Each source's rows, in a hashed order, are cut into blocks. With w the source's share of the weights, an exact fraction,
block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w); in each slot the released block that is
due first is placed. On one server such unit jobs always meet their deadlines under earliest-deadline-first, so after every
slot a source has had its share up to less than one block, however many slots went before, while all sources last.
A sort by deadlines alone would not do: without the releases, a source may run ahead by many blocks.

A source that runs out leaves its slots empty and the others close up, in their own proportions. Nothing is dropped or
repeated. A slot depends on those before, so the blocks' sources are worked out in one pass on the driver, from one count
per source: a heap step and about 30 bytes a block of ``block_rows`` rows. The rows themselves stay distributed.
"""

from __future__ import annotations

import math
from array import array
from fractions import Fraction
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import global_index
from riskframe.session import stage

BLOCK_ROWS = 16
CHUNK = 64  # blocks of a source whose slots travel as one row
BROADCAST_BLOCKS = 4_000_000  # slots of 8 bytes
TEMPER = 0.7  # default weight of a source: its rows to this power


def _named(source: Column) -> Column:
    """A source's name behind "=", so that a null source (the empty string here) is apart from an empty name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _toss(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def tempered(docs: DataFrame, source: str = "source") -> dict[str | None, float]:
    """The default weight of every source, by its name as a string: one number per source meets on the driver."""
    rows = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count("*").alias("rows"))
    return {r["source"]: float(r["rows"]) ** TEMPER for r in rows.collect()}


def quotas(sources: DataFrame, cycle: int) -> DataFrame:
    """(source, quota) of a plan that repeats a short cycle: whole slots of the cycle, at least one each; ``cycle`` grows to hold every source four times."""
    every = Window.partitionBy(F.lit(0))
    wide = sources.withColumn("slots", F.greatest(F.lit(cycle), 4 * F.count("*").over(every)))
    share = F.col("weight") / F.sum("weight").over(every) * (F.col("slots") - F.count("*").over(every))
    parts = wide.withColumn("share", share).withColumn("whole", F.floor("share"))
    left = F.col("slots") - F.count("*").over(every) - F.sum("whole").over(every)
    turn = F.row_number().over(every.orderBy(F.desc(F.col("share") - F.col("whole")), "source"))
    return parts.withColumn("quota", (1 + F.col("whole") + F.when(turn <= left, 1).otherwise(0)).cast("int")).select("source", "quota", F.col("slots").cast("int").alias("slots"))


def schedule(quota: DataFrame) -> DataFrame:
    """(source, j, slot) for one cycle, by earliest deadline first among released blocks."""
    table = quota.groupBy("slots").agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("tasks"))
    far = F.lit(2**30)

    def step(acc: Column, t: Column) -> Column:
        def due(task: Column, i: Column) -> Column:
            done, q = F.get(acc["done"], i), task["quota"]
            open_ = (done < q) & (F.floor(done * F.col("slots") / q) <= t)
            return F.struct(F.when(open_, F.ceil((done + 1) * F.col("slots") / q)).otherwise(far).cast("int").alias("due"), i.alias("i"))

        pick = F.array_min(F.transform(F.col("tasks"), due))["i"]
        done = F.transform(acc["done"], lambda d, i: F.when(i == pick, d + 1).otherwise(d))
        return F.struct(done.alias("done"), F.concat(acc["order"], F.array(pick)).alias("order"))

    start = F.struct(F.transform("tasks", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))
    folded = table.select("tasks", F.aggregate(F.sequence(F.lit(0), F.col("slots") - 1), start, step, lambda acc: acc["order"]).alias("order"))
    slots = folded.select("tasks", F.posexplode("order").alias("slot", "i")).select("slot", F.get("tasks", F.col("i"))["source"].alias("source"))
    nth = Window.partitionBy("source").orderBy("slot")
    return slots.select("source", (F.row_number().over(nth) - 1).alias("j"), "slot")


def deal(weights: list[float], blocks: list[int]) -> np.ndarray:
    """The source of every slot, by earliest deadline first among released blocks; empty slots are left out."""
    exact = [Fraction(w) for w in weights]
    unit = math.lcm(*[w.denominator for w in exact])
    whole = [int(w * unit) for w in exact]
    total, done, order, t = sum(whole), [0] * len(whole), array("i"), 0
    ready: list[tuple[int, int]] = []
    later = [(0, i) for i, n in enumerate(blocks) if n]
    while ready or later:
        if not ready:
            t = max(t, later[0][0])
        while later and later[0][0] <= t:
            i = heappop(later)[1]
            heappush(ready, (-(-(done[i] + 1) * total // whole[i]), i))
        i = heappop(ready)[1]
        order.append(i)
        done[i] += 1
        t += 1
        if done[i] < blocks[i]:
            heappush(later, (done[i] * total // whole[i], i))
    return np.frombuffer(order, np.intc) if order else np.zeros(0, np.intc)


def _slots(order: np.ndarray, sources: int) -> pa.Table:
    """(id, chunk, slots): the slots of ``CHUNK`` blocks of a source each, in order."""
    slots = np.argsort(order, kind="stable")
    count = np.bincount(order, minlength=sources)
    chunks = -(-count // CHUNK)
    ids = np.repeat(np.arange(sources), chunks)
    chunk = np.arange(len(ids)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    heads = np.repeat(np.cumsum(count) - count, chunks) + chunk * CHUNK
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(slots)), pa.int32()), pa.array(slots, pa.int64()))
    return pa.table({"id": pa.array(ids, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "slots": lists})


def mix(docs: DataFrame, weights: DataFrame | None = None, block_rows: int = BLOCK_ROWS, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Every row with its place in the mix: key, source, toss (a hash of key and text), block, share, slot, position (gapless from 0).

    ``share`` is the source's target share, and ``slot`` the place of its block among all blocks. ``weights`` has (source,
    weight); sources that it leaves out, or gives no positive weight, follow after all others with equal weights and a
    null share. Without it a source's weight is its rows to the power ``TEMPER``. A null source is a source of its own.
    Rows of one key are ordered by their text; repeated rows stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), _named(F.col(source)).alias("source"), _toss(key, text).alias("toss"))
    narrow = global_index(rows, F.col("source"), F.col("toss"), F.col("key"))
    sizes = stage(narrow.groupBy("source").agg(F.min("idx").alias("first"), F.count("*").alias("rows")))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("rows"), F.lit(TEMPER)))
    else:
        given = weights.select(_named(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight")).groupBy("source").agg(F.max("weight").alias("weight"))
        weighed = sizes.join(given, "source", "left").withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")))
    table = sorted((r["weight"] is None, r["source"], r["first"], r["rows"], r["weight"]) for r in weighed.collect())
    named = sum(not late for late, *_ in table)
    blocks = [-(-n // block_rows) for _, _, _, n, _ in table]
    order = np.concatenate([deal([x[4] for x in table[:named]], blocks[:named]), named + deal([1.0] * (len(table) - named), blocks[named:])])
    every = math.fsum(x[4] for x in table[:named])
    known = spark.createDataFrame([(i, x[1], x[2], None if x[0] else x[4] / every) for i, x in enumerate(table)], "id int, source string, first long, share double")
    places = spark.createDataFrame(_slots(order, len(table)), "id int, chunk long, slots array<long>")
    placed = narrow.join(F.broadcast(known), "source")  # one row per source
    placed = placed.withColumn("block", F.floor((F.col("idx") - F.col("first")) / block_rows)).withColumn("chunk", F.floor(F.col("block") / CHUNK))
    placed = placed.join(F.broadcast(places) if len(order) <= BROADCAST_BLOCKS else places, ["id", "chunk"])
    placed = placed.withColumn("slot", F.get("slots", (F.col("block") % CHUNK).cast("int"))).drop("slots", "first", "chunk", "id")
    out = global_index(placed, F.col("slot"), F.col("idx"), name="position")
    return out.select(
        F.col("key").alias(key), F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias(source), "toss",
        F.col("block").cast("long").alias("block"), "share", F.col("slot").cast("long").alias("slot"), F.col("position").cast("long").alias("position"),
    )


def mixed_rows(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The input rows in the order of the mix: written out, the files hold it in turn. Equal rows share one place."""
    places = mix(docs, weights).groupBy(F.col("doc_id").alias("_id"), F.col("toss").alias("_toss"), _named(F.col("source")).alias("_named")).agg(F.min("position").alias("_place"))
    load = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("load"), F.col("doc_id").alias("id"), _toss("doc_id", "text").alias("toss"), _named(F.col("source")).alias("named"))
    placed = load.join(places, F.col("id").eqNullSafe(F.col("_id")) & (F.col("toss") == F.col("_toss")) & (F.col("named") == F.col("_named")))
    return placed.repartitionByRange("_place", "id").sortWithinPartitions("_place", "id").select("load.*")
