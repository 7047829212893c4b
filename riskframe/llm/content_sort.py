"""Exact deduplication by sorting the content itself.

Rows are range-partitioned by their normalised text: the leading characters, then a digest that orders texts with one
beginning, against splitters that Spark samples. Each partition is sorted (externally, if it must spill) by the whole
text, so equal texts end up adjacent, and every row is compared in full with the row before it. The digest never
decides equality.

A text that a sample shows to be very common is spread over several splitter ranges by a salt; each range keeps the
result of its own comparisons, and the few (text, salt) heads are then merged by comparing their full texts. The sample
only decides how work is spread. Shuffled: every text once, plus one row per (common text, salt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import ascii_lower
from riskframe.session import shuffle_partitions

SAMPLE_ROWS = 50_000  # rows looked at to find common texts; decides only the spreading
PREFIX = 48  # characters of the text that lead the splitter key


def _common(rows: DataFrame, n: int, parts: int) -> DataFrame:
    """(digest, salts) of texts that fill more than about half a partition; at most ``4 * parts`` rows."""
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    seen = rows.sample(share, seed=7).select(F.sha2("norm", 256).alias("hot")).groupBy("hot").agg(F.count("*").alias("seen"))
    least = max(2.0, share * n / parts / 2)
    top = seen.filter(F.col("seen") >= least).orderBy(F.desc("seen"), "hot").limit(4 * parts)
    return top.select("hot", F.ceil(4 * parts * F.col("seen") / (share * n)).cast("int").alias("salts"))


def content_sort(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``key``, keep_id, group_size, kept, text_sha256, and the columns named in ``carry``.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The row with the largest key
    stays; rows that repeat key and text keep one of them, and a null key is smaller than any other. An empty table
    gives an empty result. ``carry`` columns travel in one struct, so their names cannot clash with the operator's.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    payload = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("id"), ascii_lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("norm"), payload.alias("load"))
    common = _common(rows, docs.count(), parts)
    dealt = (
        rows.withColumn("digest", F.sha2("norm", 256))
        .join(F.broadcast(common), F.col("digest") == F.col("hot"), "left")
        .withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("salts"))).otherwise(F.lit(-1)).cast("int"))
        .withColumn("lead", F.substring("norm", 1, PREFIX))
        .drop("hot", "salts")
    )
    at = ["lead", "digest", "salt"]
    by_text = Window.partitionBy(*at).orderBy("norm", F.desc("id"))
    fresh = F.lag("norm").over(by_text).isNull() | (F.lag("norm").over(by_text) != F.col("norm"))
    runs = (
        dealt.repartitionByRange(*at)
        .withColumn("fresh", fresh.cast("int"))
        .withColumn("run", F.sum("fresh").over(by_text.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("head", F.when((F.col("fresh") == 1) & (F.col("salt") >= 0), F.col("norm")))
        .drop("norm")
    )
    one = Window.partitionBy(*at, "run")
    within = runs.withColumn("top", F.max("id").over(one)).withColumn("n", F.count("*").over(one)).withColumn("leads", F.col("fresh") == 1)
    within = within.select("id", "load", "digest", "salt", "run", "head", "top", "n", "leads")
    if common.isEmpty():
        merged = within.withColumn("keep_id", F.col("top")).withColumn("group_size", F.col("n")).withColumn("kept", F.col("leads"))
    else:
        merged = _merge_salts(within)
    out = merged.select(F.col("id").alias(key), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"), "load")
    return out if carry else out.drop("load")


def _merge_salts(within: DataFrame) -> DataFrame:
    """Join the ranges of each common text: heads with equal full texts are one group."""
    heads = within.filter(F.col("head").isNotNull()).select("digest", "salt", "run", "head", F.col("top").alias("t"), F.col("n").alias("m"))
    group = Window.partitionBy("digest", "head")
    best = group.orderBy(F.desc_nulls_last("t"), "salt")
    joined = heads.select(
        F.col("digest").alias("d"), F.col("salt").alias("s"), F.col("run").alias("r"),
        F.max("t").over(group).alias("all_top"), F.sum("m").over(group).alias("all_n"), (F.row_number().over(best) == 1).alias("wins"),
    )
    # at most 4 * parts common texts times their salts, about 8 * parts rows in all
    same: Column = (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("run") == F.col("r"))
    return (
        within.join(F.broadcast(joined), same, "left")
        .withColumn("keep_id", F.when(F.col("salt") >= 0, F.col("all_top")).otherwise(F.col("top")))
        .withColumn("group_size", F.when(F.col("salt") >= 0, F.col("all_n")).otherwise(F.col("n")))
        .withColumn("kept", F.when(F.col("salt") >= 0, F.col("leads") & F.col("wins")).otherwise(F.col("leads")))
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    out = content_sort(docs, carry=docs.columns)
    return out.filter("kept").select("load.*")
