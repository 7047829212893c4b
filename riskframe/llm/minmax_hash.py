"""Near copies by min-max hashing: signatures that keep the minimum and the maximum under each permutation.

1. A text's set of word pairs is put through ``HASHES`` permutations, and of each both ends are kept: two values for one
   evaluation, each matching with the sets' similarity. Min and max of one permutation never share a band, so a
   band's values are independent; that the two ends exclude each other's shingle only lowers the variance over bands.
2. Documents with equal sets are one class. ``ROWS`` values are a band; two sets of similarity T share none of the bands with
   probability (1 - T**ROWS)**(2 * HASHES / ROWS), 2e-9 at T = 0.8.
3. Stars: each class is checked, on the whole sets, against the smallest class of most of its buckets; links are
   contracted into components, and buckets of one component are done.
4. In what is left, sketches meet in blocks (``near_links``): first each set's best partner of another component, then, after
   contraction, all pairs of different components that the bound admits. All are checked on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stage_table, text_steps
from riskframe.llm.near_links import PERCENT, STEP, classes_of, component_rows, components_of, digest, linked, lists, sketch
from riskframe.llm.words import mix64, shingles

SHINGLE = 2
HASHES = 125
ROWS = 5

_SEEDS = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _ODD = (_SEEDS[:HASHES] >> np.uint64(32)).astype(np.uint32), (_SEEDS[HASHES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sets x 2 x ``HASHES``: minimum and maximum of each set (none empty) under each permutation of 32 bits."""
    v = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, 2, HASHES), np.uint32)
    for j in range(HASHES):
        h = (v ^ _XOR[j]) * _ODD[j]
        out[:, 0, j] = np.minimum.reduceat(h, bounds[:-1])
        out[:, 1, j] = np.maximum.reduceat(h, bounds[:-1])
    return out


def bands(sign: np.ndarray) -> np.ndarray:
    """Sets x bands: one hash of ``ROWS`` values, all minima or all maxima, and of the band's number."""
    n = sign.shape[0]
    parts = sign.reshape(n, -1, ROWS).astype(np.uint64)
    out = np.tile(mix64(np.arange(1, parts.shape[1] + 1, dtype=np.uint64)), (n, 1))
    for r in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return out.view(np.int64)


def _leads(docs: DataFrame) -> DataFrame:
    """Per row: size, digest, sketch and bands of its set; nulls where it is empty."""

    def work(batches):
        for b in text_steps(batches, STEP):
            value, bounds = shingles(b.column("text").to_pylist(), SHINGLE)
            n = np.diff(bounds)
            some = n > 0
            spans = [value[lo:hi] if hi > lo else None for lo, hi in zip(bounds[:-1], bounds[1:])]
            found = bands(signatures(value, np.append(bounds[:-1][some], bounds[-1]))) if some.any() else np.zeros((0, 1), np.int64)
            offs = np.append(0, np.cumsum(np.where(some, found.shape[1], 0)))
            cols = [b.column("rid"), b.column("key"), b.column("h"), pa.array(n.astype(np.int32)), pa.array([None if s is None else digest(s) for s in spans], pa.binary()), pa.array([None if s is None else sketch(s) for s in spans], pa.binary()), lists(found.ravel(), offs)]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "key", "h", "n", "digest", "sketch", "bands"])

    return docs.mapInArrow(work, "rid long, key long, h long, n int, digest binary, sketch binary, bands array<long>")


def _sets(texts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    value, bounds = shingles(texts, SHINGLE)
    return value.view(np.int64), bounds, [digest(value[lo:hi]) for lo, hi in zip(bounds[:-1], bounds[1:])]


def _against(center: np.ndarray):
    center = center.view(np.uint64)

    def check(other: np.ndarray) -> bool:
        other = other.view(np.uint64)
        if 100 * min(len(other), len(center)) < PERCENT * max(len(other), len(center)):
            return False
        at = np.minimum(np.searchsorted(center, other), len(center) - 1)
        return int((center[at] == other).sum()) * (100 + PERCENT) >= PERCENT * (len(other) + len(center))

    return check


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rid, key, n, digest) of every row, (cls, digest, of, first) of every class, and (node, root) of the linked classes."""
    docs = docs.withColumn("h", F.xxhash64("text"))
    lead = stage_table(_leads(docs))
    groups, classes = classes_of(lead)
    buckets = classes.select("cls", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("cls").alias("a"), F.count("*").alias("m")).filter("m > 1").select("bucket", "a")
    shared = stage_table(buckets.join(heads, "bucket"))
    votes = shared.filter("a <> cls").groupBy("a", F.col("cls").alias("b")).agg(F.count("*").alias("of"))
    stars = votes.groupBy("b").agg(F.max(F.struct("of", "a"))["a"].alias("a")).select("a", "b")
    return lead, groups, components_of(shared.select("bucket", "cls"), stars, classes, lambda pairs: linked(pairs, classes, docs, _sets, _against))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id that it reaches by links), kept.

    Null, empty and blank texts have no shingles and link to nothing; a one-word text is one shingle. Rows with equal sets
    are linked, repeated rows included. A null id is never the smallest; a row that reaches no other id keeps its own,
    and is kept where both are equal or null. An empty table gives an empty result. Other columns are ignored.
    Shingles are 64-bit hashes, classes 128-bit digests of sets.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return component_rows(*classes_and_links(rows)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
