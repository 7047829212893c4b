"""Linear projections. The data is read once into d x d sums; only those reach the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.operators.neighbors import _matrix
from riskframe.operators.profile import vector_summary

MAX_WIDTH = 4096


def gram(df: DataFrame, col: str = "features", mean: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of the (centred) rows: one partial matrix per task, added up row by row."""

    def partial(batches):
        total = None
        for b in batches:
            if len(b):
                m = _matrix(b["f"])
                m = m - mean if mean is not None else m
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total), dtype=np.int32), "row": list(total)})

    first = df.select(F.size(col).alias("d")).first()
    if first and first["d"] > MAX_WIDTH:
        raise ValueError(f"more than {MAX_WIDTH} features: select features first")
    parts = df.select(F.col(col).cast("array<double>").alias("f")).mapInPandas(partial, "i int, row array<double>")
    rows = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def _signed(components: np.ndarray) -> np.ndarray:
    """Largest entry of each component made positive, so that a refit gives the same signs."""
    at = np.abs(components).argmax(axis=1)
    return components * np.sign(components[np.arange(len(components)), at])[:, None]


def fit_pca(df: DataFrame, k: int | None = None, variance: float = 0.95, col: str = "features") -> dict:
    """Smallest number of components whose variance share exceeds ``variance``, or min(k, d) components."""
    s = vector_summary(df, (), col).first()
    mean, n = np.array(s["mean"]), s["n"]
    values, vectors = np.linalg.eigh(gram(df, col, mean) / max(1, n - 1))
    order = values.argsort()[::-1]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    share = values / values.sum()
    keep = min(k, len(mean)) if k else int(np.searchsorted(np.cumsum(share), variance, side="right") + 1)
    keep = min(keep, len(mean))
    return {"mean": mean.tolist(), "components": _signed(vectors[:keep]).tolist(), "share": share[:keep].tolist()}


def fit_svd(df: DataFrame, k: int, col: str = "features") -> dict:
    """Truncated SVD without centring: k leading right singular vectors."""
    values, vectors = np.linalg.eigh(gram(df, col))
    order = values.argsort()[::-1][:k]
    return {"mean": None, "components": _signed(vectors[:, order].T).tolist(), "singular": np.sqrt(np.maximum(values[order], 0)).tolist()}


def fit_lda1(df: DataFrame, label: str = "target", col: str = "features", ridge: float = 1e-9) -> dict:
    """One discriminant direction: pooled within-class covariance solved against the difference of means."""
    s = {r[label]: r for r in vector_summary(df, [label], col).collect()}
    if len(s) != 2:
        raise ValueError("the discriminant needs exactly two classes")
    lo, hi = sorted(s)
    n = sum(r["n"] for r in s.values())
    within = sum(gram(df.filter(F.col(label) == F.lit(c)), col, np.array(s[c]["mean"])) for c in s) / max(1, n - 2)
    within = within + ridge * np.trace(within) / len(within) * np.eye(len(within))
    m0, m1 = np.array(s[lo]["mean"]), np.array(s[hi]["mean"])
    w = np.linalg.solve(within, m1 - m0)
    w = w / np.sqrt(w @ within @ w)
    mean = (s[lo]["n"] * m0 + s[hi]["n"] * m1) / n
    return {"mean": mean.tolist(), "components": [w.tolist()]}


def project(df: DataFrame, fitted: dict, col: str = "features", out: str = "projected") -> DataFrame:
    """Row vectors onto the fitted components, batch by batch."""
    c = np.asarray(fitted["components"], dtype=np.float64)
    mean = None if fitted.get("mean") is None else np.asarray(fitted["mean"])

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = _matrix(x)
        return pd.Series(list((m if mean is None else m - mean) @ c.T))

    return df.withColumn(out, run(F.col(col).cast("array<double>")))
