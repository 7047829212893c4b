"""Embedding columns: detect, pack, expand; hashed text embeddings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.exprs import d, hex_int, l2_norm, lit_array

MARK = "_emb_"  # fixed value: separator of prefix and position in an embedding column name


def emb_groups(cols: list[str]) -> dict[str, list[str]]:
    """``{prefix}_emb_{digits}`` columns by prefix (text before the last mark), in numeric order."""
    found: dict[str, list[tuple[int, str]]] = {}
    for c in cols:
        prefix, mark, digits = c.rpartition(MARK)
        if mark and prefix and digits.isdigit():
            found.setdefault(prefix, []).append((int(digits), c))
    return {p: [c for _, c in sorted(v)] for p, v in found.items()}


def pack_embeddings(df: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Each group becomes ``{prefix}_emb_vector`` and its L2 norm ``{prefix}_emb_norm``."""
    groups = emb_groups(df.columns) if groups is None else groups
    packed = {c for g in groups.values() for c in g}
    rest = [c for c in df.columns if c not in packed]
    out = df.select(*rest, *[F.array(*[F.col(c).cast("double") for c in g]).alias(f"{p}_emb_vector") for p, g in groups.items()])
    return out.withColumns({f"{p}_emb_norm": l2_norm(F.col(f"{p}_emb_vector")) for p in groups}) if groups else out


def expand_embeddings(df: DataFrame, col: str, prefix: str, n: int) -> DataFrame:
    """Array column to ``{prefix}_emb_dim_{i}``."""
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, *[F.get(F.col(col), F.lit(i)).alias(f"{prefix}_emb_dim_{i}") for i in range(n)])


def tokens(text: Column, ngram: int = 1) -> Column:
    """Lower-cased whitespace tokens, optionally joined to n-grams."""
    t = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    if ngram == 1:
        return t
    idx = F.sequence(F.lit(1), F.size(t) - (ngram - 1))
    return F.when(F.size(t) < ngram, F.array().cast("array<string>")).otherwise(
        F.transform(idx, lambda i: F.array_join(F.slice(t, i, ngram), " "))
    )


def text_counts(df: DataFrame, col: str, dim: int = 64, ngram: int = 1, out: str = "tf") -> DataFrame:
    """Token counts per hash bucket, inside the row: no token leaves its document, so nothing is shuffled.

    Tokens are hashed in the JVM; only the bucket numbers go through Arrow to be counted.
    """

    @F.pandas_udf("array<double>")
    def count(buckets: pd.Series) -> pd.Series:
        sizes = np.array([len(b) for b in buckets], np.int64)
        flat = np.concatenate(buckets.tolist()) if sizes.sum() else np.zeros(0, np.int64)
        # one count for the whole batch
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * dim + flat.astype(np.int64), minlength=len(sizes) * dim)
        return pd.Series(list(counts.reshape(len(sizes), dim).astype(np.float64)))

    buckets = F.transform(tokens(F.col(col), ngram), lambda t: (hex_int(F.md5(t.cast("binary"))) % dim).cast("int"))
    return df.withColumn(out, count(F.coalesce(buckets, F.array().cast("array<int>"))))


def fit_idf(counted: DataFrame, tf: str = "tf") -> list[float]:
    """idf per bucket from counted documents: ln((1 + N) / (1 + df)) + 1."""
    hit = F.transform(tf, lambda x: (x > 0).cast("double"))
    row = counted.select(array_to_vector(hit).alias("v")).agg(F.count("*").alias("n"), Summarizer.sum(F.col("v")).alias("df")).first()
    return [math.log((1 + row["n"]) / (1 + x)) + 1 for x in row["df"].toArray()]


def apply_idf(counted: DataFrame, idf: list[float], tf: str = "tf", out: str = "features") -> DataFrame:
    """Weighted counts, L2-normalised; text without tokens gives zeros."""
    w = counted.withColumn("__w", F.zip_with(tf, lit_array(idf), lambda a, b: a * b)).withColumn("__n", l2_norm(F.col("__w")))
    return w.withColumn(out, F.transform("__w", lambda x: F.when(F.col("__n") == 0, d(0)).otherwise(x / F.col("__n")))).drop(tf, "__w", "__n")


def fit_text(df: DataFrame, col: str, dim: int = 64, ngram: int = 1) -> list[float]:
    return fit_idf(text_counts(df, col, dim, ngram))


def text_embedding(df: DataFrame, col: str, idf: list[float], ngram: int = 1, out: str = "features") -> DataFrame:
    """Hashed tf-idf vector of each text. Count once (``text_counts``) to fit and apply on the same rows."""
    return apply_idf(text_counts(df, col, len(idf), ngram, "__tf"), idf, "__tf", out)
