"""Fitted state: a few numbers per column, kept as rows and applied as literals.

Only state whose size is set by the schema (columns x a handful of numbers) lives here. Dictionaries that
grow with the data stay DataFrames.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Fitted:
    kind: str
    cols: dict[str, dict] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [("__meta__", json.dumps({"kind": self.kind, **self.meta}))]
        rows += [(c, json.dumps(p)) for c, p in self.cols.items()]
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, name string, payload string")

    @staticmethod
    def from_df(df: DataFrame) -> "Fitted":
        rows = sorted(df.collect(), key=lambda r: r["pos"])
        meta = json.loads(rows[0]["payload"])
        return Fitted(meta.pop("kind"), {r["name"]: json.loads(r["payload"]) for r in rows[1:]}, meta)
