"""Working frames on the star-schema tables: company, vectors, labelled documents, scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, hash_unit
from riskframe.session import stage

NUMERIC = ["n_orders", "sum_price", "avg_disc", "max_qty", "ret_share", "urgent_avg", "open_avg"]
STRINGS = ["seg", "urgent_status"]
TIE = 1e-10  # moves exact halves off the rounding edge, so every engine rounds them alike


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with order and line features; averages over missing orders are null.

    Lines are summed per order first, so the big table is shuffled once, already reduced, on the join key.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum("l_discount").alias("disc"),
            F.count("*").alias("n_lines"),
            F.max("l_quantity").alias("qty"),
            F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
        )
    )
    urgent = F.col("o_orderpriority") == "1-URGENT"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    per = (
        orders.join(lines, "o_orderkey", "left")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count("*").alias("n_orders"),
            F.sum("o_totalprice").alias("price"),
            F.sum("disc").alias("disc"),
            F.sum("n_lines").alias("n_lines"),
            F.max("qty").alias("max_qty"),
            F.sum("n_ret").alias("n_ret"),
            F.avg(F.when(urgent, F.col("o_totalprice"))).alias("urgent"),
            F.avg(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("open"),
            # status letters as numbers: a string minimum would force a sort-based aggregate
            F.char(F.min(F.when(urgent, F.ascii("o_orderstatus")))).alias("urgent_status"),
        )
    )
    return (
        table(spark, sf_dir, "customer")
        .join(per, "c_custkey", "left")
        .select(
            F.col("c_custkey").alias("company_id"),
            F.col("c_mktsegment").alias("seg"),
            F.col("c_nationkey").alias("nation"),
            F.coalesce("n_orders", F.lit(0)).cast("double").alias("n_orders"),
            F.round(F.col("price") / d(1e6) + d(TIE), 4).alias("sum_price"),
            F.round(F.col("disc") / F.col("n_lines") + d(TIE), 6).alias("avg_disc"),
            F.col("max_qty"),
            F.round(F.col("n_ret") / F.col("n_lines") + d(TIE), 6).alias("ret_share"),
            F.round(F.col("urgent") / d(1e5) + d(TIE), 4).alias("urgent_avg"),
            F.round(F.col("open") / d(1e5) + d(TIE), 4).alias("open_avg"),
            d(5).alias("zero_var"),
            "urgent_status",
            (F.col("c_acctbal") < d(0)).cast("int").alias("target"),
        )
    )


def company_table(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Chosen company columns, written once: fitting and applying both read this small table, so orders and
    lines are aggregated a single time (and not at all when no column needs them)."""
    df = company(spark, sf_dir)
    return stage(df.select(*cols) if cols else df)


COMPANY_SQL = """
company AS (
  SELECT c_custkey AS company_id, c_mktsegment AS seg, c_nationkey AS nation,
    coalesce(n_orders, 0)::double AS n_orders, round(price / 1e6::double + 1e-10::double, 4) AS sum_price,
    round(disc / n_lines + 1e-10::double, 6) AS avg_disc, max_qty, round(n_ret / n_lines + 1e-10::double, 6) AS ret_share,
    round(urgent / 1e5::double + 1e-10::double, 4) AS urgent_avg, round(open_ / 1e5::double + 1e-10::double, 4) AS open_avg,
    5.0::double AS zero_var, urgent_status, (c_acctbal < 0)::int AS target
  FROM customer LEFT JOIN (
    SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS price, sum(disc) AS disc, sum(n_lines)::double AS n_lines,
      max(qty) AS max_qty, sum(n_ret)::double AS n_ret,
      avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
      avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS open_,
      min(o_orderstatus) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_status
    FROM orders LEFT JOIN (
      SELECT l_orderkey, sum(l_discount) AS disc, count(*) AS n_lines, max(l_quantity) AS qty,
        count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret
      FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    GROUP BY 1) ON o_custkey = c_custkey
)"""


def vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 0).cast("int").alias("target"),
    )


VEC_SQL = """
vec AS (SELECT vec_id AS id, embedding::double[] AS features, (label = 0)::int AS target FROM embeddings)"""


def vec_wide(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """Embedding spread over named columns ``a_emb_0 ..``."""
    v = vec(spark, sf_dir)
    return v.select("id", *[F.col("features")[i].alias(f"a_emb_{i}") for i in range(dim)], "target")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a rare label and two key-hashed scores; ``p_b`` has two decimals, hence many ties."""
    y = ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).cast("int")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key.alias("id"), y.alias("y")).select(
        "id",
        "y",
        F.round(d(0.8) * hash_unit("a", F.col("id")) + d(0.2) * F.col("y"), 6).alias("p_a"),
        F.round(d(0.65) * hash_unit("b", F.col("id")) + d(0.35) * F.col("y"), 2).alias("p_b"),
    )


SCORED_SQL = """
scored AS (
  SELECT id, y,
    round(0.8::double * (('0x' || substr(md5('a|' || id), 1, 8))::bigint / 4294967296::double) + 0.2::double * y, 6) AS p_a,
    round(0.65::double * (('0x' || substr(md5('b|' || id), 1, 8))::bigint / 4294967296::double) + 0.35::double * y, 2) AS p_b
  FROM (SELECT o_orderkey AS id, (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')::int AS y FROM orders)
)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"
