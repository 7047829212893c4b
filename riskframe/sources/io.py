"""Readers and writers: CSV with a pinned schema, Parquet, prediction and submission tables, fitted bundles."""

from __future__ import annotations

import dataclasses
import importlib
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.operators.fitted import Fitted


def infer_schema(spark: SparkSession, path: str, sampling: float = 1.0) -> T.StructType:
    """Infer a CSV schema once; pin it in ``read_csv`` afterwards."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sampling).schema


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    skip_rows: int = 0,
    rename: dict[str, str] | None = None,
) -> DataFrame:
    """CSV with a header row; empty fields are null. Splits are read in parallel.

    ``skip_rows`` banner lines before the header are dropped by their place at the head of each file; data lines that
    read the same stay. The scan itself stays distributed.
    """
    opts = {"header": True, "enforceSchema": True, "quote": '"', "escape": '"'}
    if skip_rows:
        head = [r["value"] for r in spark.read.text(path).limit(skip_rows + 1).collect()]
        banner, header = head[:skip_rows], head[skip_rows]
        lines = _below_header(spark, path, [*banner, header])
        if schema is None:
            schema = T.StructType([T.StructField(n.strip().strip('"'), T.StringType()) for n in header.split(",")])
        elif isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        parsed = lines.select(F.from_csv("value", ddl, {"quote": '"', "escape": '"'}).alias("r"))
        df = parsed.select("r.*")
    else:
        df = spark.read.csv(path, schema=schema or infer_schema(spark, path), **opts)
    return df.withColumnsRenamed(rename) if rename else df


def _below_header(spark: SparkSession, path: str, head: list[str]) -> DataFrame:
    """Lines after the first ``len(head)`` of each file. Only lines that read like one of ``head`` in a file's first
    block are numbered; the last of the head's places, one row per file, then cuts that block."""
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    lines = spark.read.text(path).select("value", *[c.alias(n) for n, c in place.items()])
    alike = lines.filter((F.col("_block") == 0) & F.col("value").isin(head))
    nth = F.row_number().over(Window.partitionBy("_file").orderBy("_row"))
    cut = alike.withColumn("_n", nth).filter(F.col("_n") == len(head)).select(F.col("_file").alias("_cut_file"), F.col("_row").alias("_cut"))
    kept = lines.join(F.broadcast(cut), F.col("_file") == F.col("_cut_file"), "left")
    return kept.filter((F.col("_block") > 0) | F.col("_cut").isNull() | (F.col("_row") > F.col("_cut"))).select("value")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write a cleaned or scored table, one file per partition."""
    w = df.write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def predictions(df: DataFrame, label: str, p: str, f1_threshold: float, recall_threshold: float | None = None) -> DataFrame:
    out = df.select(
        F.col(label).cast("int").alias("true_label"),
        F.col(p).cast("double").alias("pred_prob"),
        (F.col(p) >= F.lit(float(f1_threshold))).cast("int").alias("pred_label_f1_optimized"),
        *(
            [(F.col(p) >= F.lit(float(recall_threshold))).cast("int").alias("pred_label_high_recall")]
            if recall_threshold is not None
            else []
        ),
    )
    return out


def write_predictions(df: DataFrame, path: str, label: str, p: str, f1_threshold: float, recall_threshold: float | None = None):
    write_table(predictions(df, label, p, f1_threshold, recall_threshold), path, "csv")


def submission(scored: DataFrame, key: str, p: str = "proba", threshold: float = 0.5) -> DataFrame:
    """``uuid, proba, prediction``."""
    pred = F.col("prediction") if "prediction" in scored.columns else (F.col(p) >= F.lit(float(threshold)))
    return scored.select(F.col(key).alias("uuid"), F.col(p).alias("proba"), pred.cast("int").alias("prediction"))


def save_bundle(bundle: dict, path: str, spark: SparkSession) -> None:
    """Persist a scoring bundle: every fitted type of this package, pipelines, tables and plain settings.

    Dictionaries, lists and fitted objects may hold each other; tables and pipelines inside them get a folder each, and
    one index says how to put them together.
    """
    index = json.dumps({name: _save(v, f"{path}/{name}", spark) for name, v in bundle.items()})
    spark.createDataFrame([(index,)], "index string").coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _save(v, at: str, spark: SparkSession) -> dict:
    if isinstance(v, Fitted):
        v.to_df(spark).coalesce(1).write.mode("overwrite").parquet(at)
        return {"type": "fitted", "path": at}
    if isinstance(v, PipelineModel):
        v.write().overwrite().save(at)
        return {"type": "model", "path": at}
    if isinstance(v, DataFrame):
        v.write.mode("overwrite").parquet(at)
        return {"type": "table", "path": at}
    if dataclasses.is_dataclass(v) and type(v).__module__.startswith("riskframe."):
        fields = {f.name: _save(getattr(v, f.name), f"{at}-{f.name}", spark) for f in dataclasses.fields(v)}
        return {"type": "object", "class": [type(v).__module__, type(v).__qualname__], "fields": fields}
    if isinstance(v, dict) and any(not _plain(x) for x in v.values()):
        return {"type": "dict", "items": [[k, _save(x, f"{at}-{i}", spark)] for i, (k, x) in enumerate(v.items())]}
    if isinstance(v, (list, tuple)) and any(not _plain(x) for x in v):
        return {"type": "list", "items": [_save(x, f"{at}-{i}", spark) for i, x in enumerate(v)]}
    return {"type": "setting", "value": v}


def _plain(v) -> bool:
    if isinstance(v, dict):
        return all(isinstance(k, str) and _plain(x) for k, x in v.items())
    return all(map(_plain, v)) if isinstance(v, (list, tuple)) else v is None or isinstance(v, (str, int, float, bool))


def load_bundle(spark: SparkSession, path: str) -> dict:
    """The bundle, from wherever its folder is now."""
    index = json.loads(spark.read.parquet(f"{path}/index").first()["index"])
    return {name: _load(spark, e, path) for name, e in index.items()}


def _load(spark: SparkSession, e: dict, path: str):
    kind = e["type"]
    at = f"{path}/{e['path'].rsplit('/', 1)[-1]}" if "path" in e else ""
    if kind == "fitted":
        return Fitted.from_df(spark.read.parquet(at))
    if kind == "model":
        return PipelineModel.load(at)
    if kind == "table":
        return spark.read.parquet(at)
    if kind == "object":
        module, name = e["class"]
        if not module.startswith("riskframe."):
            raise ValueError(f"not a fitted type of this package: {module}.{name}")
        return getattr(importlib.import_module(module), name)(**{k: _load(spark, x, path) for k, x in e["fields"].items()})
    if kind == "dict":
        return {k: _load(spark, x, path) for k, x in e["items"]}
    if kind == "list":
        return [_load(spark, x, path) for x in e["items"]]
    return e["value"]
