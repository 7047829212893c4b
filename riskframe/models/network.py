"""A small feed-forward network whose rows carry weights, fitted by full gradients.

Every task adds up the weighted gradients of its rows in one vector, and the vectors are added by one map-side-combined
sum; only that sum, as long as the network has weights, reaches the driver. Hidden units are tanh, the output is logistic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from riskframe.functions.exprs import d


def matrices(theta: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of every layer, cut from one vector."""
    out, at = [], 0
    for n, m in zip(layers, layers[1:]):
        out.append((theta[at : at + n * m].reshape(n, m), theta[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def forward(x: np.ndarray, parts) -> list[np.ndarray]:
    """Outputs of every layer, the input first; the last are probabilities."""
    out = [x]
    for i, (w, b) in enumerate(parts):
        z = out[-1] @ w + b
        out.append(np.tanh(z) if i < len(parts) - 1 else 0.5 * (1 + np.tanh(z / 2)))
    return out


def gradient_sum(x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, layers: list[int]) -> np.ndarray:
    """Weighted gradient of the log loss added up over the rows, then loss and weight."""
    parts = matrices(theta, layers)
    out = forward(x, parts)
    p = np.clip(out[-1][:, 0], 1e-15, 1 - 1e-15)
    delta = ((out[-1][:, 0] - y) * w)[:, None]
    grads = []
    for i in range(len(parts) - 1, -1, -1):
        grads = [(out[i].T @ delta).ravel(), delta.sum(axis=0), *grads]
        if i:
            delta = (delta @ parts[i][0].T) * (1 - out[i] ** 2)
    return np.concatenate([*grads, [-(w * np.where(y == 1, np.log(p), np.log(1 - p))).sum(), w.sum()]])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def gradient(rows: DataFrame, theta: np.ndarray, layers: list[int]) -> tuple[np.ndarray, float]:
    """(gradient, loss), both by unit of weight, of rows (features, y, w)."""

    def work(batches):
        total = None
        for b in batches:
            part = gradient_sum(_matrix(b.column("features"), layers[0]), b.column("y").to_numpy(), b.column("w").to_numpy(), theta, layers)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["g"])

    sums = rows.select("features", "y", "w").mapInArrow(work, "g array<double>")
    got = sums.groupBy(F.lit("all")).agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("g")))).alias("g")).first()  # no row of an empty table
    if got is None or not got["g"][-1]:
        raise ValueError("no rows with a weight to fit on")
    g = np.array(got["g"])
    return g[:-2] / g[-1], float(g[-2] / g[-1])


def weighted_rows(df: DataFrame, label: str, weight: str | None = None, pos_weight: float = 1.0, col: str = "features") -> DataFrame:
    """(features, y, w): the row weight, times ``pos_weight`` on positives."""
    w = F.col(weight).cast("double") if weight else d(1)
    return df.select(F.col(col).alias("features"), F.col(label).cast("double").alias("y"), (w * F.when(F.col(label) == 1, d(pos_weight)).otherwise(d(1))).alias("w"))


def fit_network(df: DataFrame, label: str, params: dict, weight: str | None = None, col: str = "features") -> dict:
    """Layers and weights after ``iterations`` steps of Adam on the whole data's gradient, and the loss of each step."""
    rows = weighted_rows(df, label, weight, params.get("pos_weight", 1.0), col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = rows.select(F.size("features").alias("n")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        layers = [first["n"], *params.get("hidden", [16, 8]), 1]
        rng = np.random.default_rng(params.get("seed", 42))
        theta = np.concatenate([np.append(rng.normal(0, np.sqrt(2 / (n + m)), n * m), np.zeros(m)) for n, m in zip(layers, layers[1:])])
        m, v, losses = np.zeros_like(theta), np.zeros_like(theta), []
        for t in range(1, params.get("iterations", 50) + 1):
            g, loss = gradient(rows, theta, layers)
            g = g + params.get("reg", 0.0) * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta - params.get("lr", 0.05) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            losses.append(loss)
    finally:
        rows.unpersist()
    first_layer = np.abs(matrices(theta, layers)[0][0]).mean(axis=1)
    return {"layers": layers, "weights": theta.tolist(), "losses": losses, "importances": first_layer.tolist()}


def score_network(state: dict, df: DataFrame, col: str, out: str) -> DataFrame:
    parts, width = matrices(np.array(state["weights"]), state["layers"]), state["layers"][0]

    @F.pandas_udf("double")
    def p(x: pd.Series) -> pd.Series:
        return pd.Series(forward(np.concatenate(x.to_numpy()).astype(float).reshape(len(x), width) if len(x) else np.zeros((0, width)), parts)[-1][:, 0])

    return df.withColumn(out, p(F.col(col)))
