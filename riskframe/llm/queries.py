"""Registered queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.balanced_shards import balanced_shards
from riskframe.llm.content_sort import content_sort
from riskframe.llm.conversation_trie import trie
from riskframe.llm.fragment_alignment import align
from riskframe.llm.minmax_hash import near_duplicates as minmax_duplicates
from riskframe.llm.mixture_packing import pack
from riskframe.llm.order_minhash import fingerprints
from riskframe.llm.pfair_mixing import mix
from riskframe.llm.pii_spans import pii_digest
from riskframe.llm.prefix_tree_join import near_duplicates
from riskframe.llm.quality_qda import quality
from riskframe.llm.toxicity_automata import toxicity
from riskframe.llm.url_templates import judge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_templates")
def op1(spark, d):
    """A page's label is the quality label of the document that it shows, whose id ends its path."""
    pages = table(spark, d, "pages").select("page_id", "url")
    shown = F.regexp_extract("url", r"/([0-9]{1,18})(?:[./?#][^/]*)?/?(?:[?#].*)?$", 1)
    shown = F.when(shown != "", shown.cast("long"))
    labels = table(spark, d, "labels").select("doc_id", (1 - F.col("quality")).alias("y"))
    marks = pages.select("page_id", shown.alias("doc_id")).filter("doc_id IS NOT NULL").join(labels, "doc_id").select("page_id", "y")
    return judge(pages, marks)


@query("op2_balanced_shards")
def op2(spark, d):
    return balanced_shards(table(spark, d, "documents"))


@query(
    "op3_content_sort",
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)
    """,
)
def op3(spark, d):
    return content_sort(table(spark, d, "documents"))


@query("op4_quality_qda")
def op4(spark, d):
    return quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op5_mixture_packing")
def op5(spark, d):
    return pack(table(spark, d, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


@query("op6_pfair_mixing")
def op6(spark, d):
    return mix(table(spark, d, "documents")).drop("toss")


@query("op7_toxicity_automata")
def op7(spark, d):
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op8_order_minhash")
def op8(spark, d):
    return fingerprints(table(spark, d, "documents"))


@query("op9_prefix_tree_join")
def op9(spark, d):
    return near_duplicates(table(spark, d, "documents"))


@query("op10_pii_spans")
def op10(spark, d):
    return pii_digest(table(spark, d, "documents"))


@query("op11_minmax_hash")
def op11(spark, d):
    return minmax_duplicates(table(spark, d, "documents"))


@query("op12_conversation_trie")
def op12(spark, d):
    return trie(table(spark, d, "conversations"))


@query("op13_fragment_alignment")
def op13(spark, d):
    return align(table(spark, d, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))
