"""Self-join of documents on the Jaccard similarity of their word shingles, by prefix trees.

1. Every text becomes its set of shingles, written in one global order: shingles are counted over all texts, the common
   ones come last by their count, the others by hash. Equal sets are one class; only classes are joined.
2. Two sets of similarity T share a shingle among their first n - ceil(T n) + 1. These leading shingles are the first
   branches of the tree: one list of classes each, streamed from sorted rows. Those that a single class holds end there,
   and shingles known to be common are dealt out in salted parts.
3. Each class is checked against the smallest class of most of its lists (stars, not all pairs); links are contracted into
   components, and lists held by one component end there. In the lists that are left, sketches of the sets meet in blocks
   (``near_links``), and pairs of different components that the bound admits are checked. No link is lost.

Checking: the sets checked against one form a trie (their ordered shingles, walked in lexicographic order). The overlap
with that one is counted once for a shared beginning, and a branch ends as soon as what is left of either set can no
longer reach the overlap needed.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stage_table, text_steps
from riskframe.llm.near_links import PERCENT, STEP, classes_of, component_rows, components_of, digest, joined_classes, linked, lists, sketch
from riskframe.llm.words import shingles
from riskframe.operators.joins import hot_join, tasks_for

SHINGLE = 5
COMMON = 3  # texts that hold a common shingle, at least; in larger tables so many of every COMMON_ROWS
COMMON_ROWS = 8_000
COUNTERS = 1 << 22  # of a shingle's counts, in each of two rows
PIECES = 16  # of the counters, summed apart
FLUSH = 60_000  # texts after which a task hands its 16-bit counters on
SALTED = 64  # parts of a common shingle's list
BINS = 1024  # of a sketch, at most: a class is on as many lists as it has leading shingles
BROADCAST = 64 << 20  # bytes of row numbers to drop; more are joined by a shuffle

_SIGN = np.uint64(1 << 63)


def needed(n: int, m: int) -> int:
    """Smallest overlap of sets of n and m with 100 * overlap >= PERCENT * union."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def lead_length(n: np.ndarray) -> np.ndarray:
    return n - -(-PERCENT * n // 100) + (n > 0)


def _counters(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counter of each shingle in both rows."""
    mask = np.uint64(COUNTERS - 1)
    return (value & mask).astype(np.int64), ((value >> np.uint64(32)) & mask).astype(np.int64)


def ordered_sets(texts, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """(sets in the global order as signed longs, bounds, digest of each set)."""
    value, bounds = shingles(texts, SHINGLE)
    ids = [digest(value[lo:hi]) if hi > lo else None for lo, hi in zip(bounds[:-1], bounds[1:])]
    one, two = _counters(value)
    key = value >> np.uint64(8) | np.minimum(level[0, one], level[1, two]).astype(np.uint64) << np.uint64(56)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        key[lo:hi].sort()
    return (key ^ _SIGN).view(np.int64), bounds, ids


def _leads(docs: DataFrame, level: np.ndarray) -> DataFrame:
    """Per row: size, digest and sketch of its set, and its leading shingles in order."""

    def work(batches):
        for b in text_steps(batches, STEP):
            value, bounds, ids = ordered_sets(b.column("text").to_pylist(), level)
            n = np.diff(bounds)
            take = lead_length(n)
            at = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(bounds[:-1], take)
            drawn = [sketch(value[lo:hi].view(np.uint64), most=BINS) if hi > lo else None for lo, hi in zip(bounds[:-1], bounds[1:])]
            cols = [b.column("rid"), b.column("key"), b.column("h"), pa.array(n.astype(np.int32)), pa.array(ids, pa.binary()), pa.array(drawn, pa.binary()), lists(value[at], np.append(0, np.cumsum(take)))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "key", "h", "n", "digest", "sketch", "lead"])

    return docs.mapInArrow(work, "rid long, key long, h long, n int, digest binary, sketch binary, lead array<long>")


def _common(docs: DataFrame, rows: int) -> np.ndarray:
    """The level of every counter, 0 where none of its shingles is common: two rows of counters over the shingles of all texts.

    The lesser of a shingle's two counts is never below the texts that hold it; what collides with it can only move it to a
    later place in the order, the same one in every text. A task sends its counters on as compressed pieces, so neither they
    nor the levels grow with the table.
    """
    part = docs.select("text").filter("text IS NOT NULL")
    share = min(1.0, COMMON_ROWS / max(rows, 1))
    size = 2 * COUNTERS // PIECES

    def packed(counts):
        pieces = [(i, zlib.compress(c.tobytes(), 1)) for i, c in enumerate(counts.reshape(PIECES, size)) if c.any()]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pieces], pa.int32()), pa.array([c for _, c in pieces], pa.binary())], names=["piece", "counts"])

    def count(batches):
        counts, held = np.zeros(2 * COUNTERS, np.uint16), 0
        for b in text_steps(batches, STEP):
            distinct = sorted(set(b.column("text").to_pylist()))
            for texts in (distinct[s : s + FLUSH] for s in range(0, len(distinct), FLUSH)):
                if held + len(texts) > FLUSH:
                    yield packed(counts)
                    counts[:], held = 0, 0
                held += len(texts)
                for row, at in enumerate(_counters(shingles(texts, SHINGLE)[0])):
                    at, n = np.unique(at.astype(np.uint32), return_counts=True)
                    counts[row * COUNTERS + at.astype(np.int64)] += n.astype(np.uint16)
        if held:
            yield packed(counts)

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("piece").to_pylist(), b.column("counts")):
                total.setdefault(i, np.zeros(size, np.int64))[:] += np.frombuffer(zlib.decompress(c.as_py()), np.uint16)
        for i, n in total.items():
            with np.errstate(divide="ignore"):
                level = np.where((n >= COMMON) & (n * share >= COMMON), np.minimum(127, 1 + 8 * np.log2(n * share)), 0)
            packed_level = zlib.compress(level.astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed_level], pa.binary())], names=["piece", "level"])

    sums = part.mapInArrow(count, "piece int, counts binary").repartition(PIECES, "piece").mapInArrow(add, "piece int, level binary")
    level = np.zeros((PIECES, size), np.uint8)
    for r in sums.collect():
        level[r["piece"]] = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
    return level.reshape(2, COUNTERS)


def _is_common(tok):
    """The level of a common shingle stands in the top byte."""
    return F.shiftright(tok, 56) > -128


def _shared(classes: DataFrame) -> DataFrame:
    """(bucket, cls, rep): leading shingles that two classes hold, with the smallest class of the list (or part).

    Rows come sorted from the shuffle, and only the latest list's first row is held back.
    """
    rows = classes.select("cls", F.explode("lead").alias("bucket"))
    rows = rows.withColumn("part", F.when(_is_common("bucket"), F.pmod("cls", F.lit(SALTED))).otherwise(F.lit(0)).cast("int"))
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "cls")

    def work(batches):
        last = None  # (bucket, part, rep, whether its first row has left)
        for b in batches:
            if not b.num_rows:
                continue
            tok, part, cls = (b.column(c).to_numpy() for c in ("bucket", "part", "cls"))
            fresh = np.ones(len(tok), bool)
            fresh[1:] = (tok[1:] != tok[:-1]) | (part[1:] != part[:-1])
            goes_on = last is not None and last[0] == tok[0] and last[1] == part[0]
            fresh[0] = not goes_on
            ends = np.append(fresh[1:], True)
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(tok)), 0))
            rep = cls[first]
            if goes_on:
                rep[: int(np.argmax(fresh)) if fresh.any() else len(tok)] = last[2]
            alone = fresh & ends
            alone[-1] = False  # the next batch may go on with it
            keep = ~alone
            keep[-1] = not fresh[-1]
            keep |= (tok >> 56) > -128
            out = [tok[keep], cls[keep], rep[keep]]
            if goes_on and not last[3]:
                out = [np.append(x, y) for x, y in zip((last[0], last[2], last[2]), out)]
            last = (tok[-1], part[-1], rep[-1], bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in out], names=["bucket", "cls", "rep"])

    return dealt.select("bucket", "part", "cls").mapInArrow(work, "bucket long, cls long, rep long")


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): each class with the smallest of its list on most of its lists; of a common shingle's parts, the
    smallest ones are on a list of their own."""
    tasks = tasks_for(shared.count())
    shared = shared.coalesce(tasks)
    heads = shared.filter(_is_common("bucket")).select("bucket", "rep").distinct().coalesce(tasks)
    tops = heads.groupBy("bucket").agg(F.min("rep").alias("a")).coalesce(tasks)
    votes = shared.select(F.col("rep").alias("a"), F.col("cls").alias("b")).unionByName(heads.join(tops, "bucket").select("a", F.col("rep").alias("b")))
    counts = votes.coalesce(tasks).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("of")).coalesce(tasks)
    return counts.groupBy("b").agg(F.max(F.struct("of", "a"))["a"].alias("a")).select("a", "b").coalesce(tasks)


class TrieWalk:
    """Overlaps of ordered sets, given in lexicographic order, with ``center``.

    ``count[d]`` is the overlap of the path's first d shingles; a set starts where it leaves the one before it.
    """

    def __init__(self, center: np.ndarray):
        self.center = center
        self.before, self.count, self.known = np.zeros(0, np.int64), np.zeros(1, np.int64), 0

    def __call__(self, m: np.ndarray) -> bool:
        """Whether the next set reaches the overlap needed."""
        center, c = self.center, len(self.center)
        short = min(len(self.before), len(m), self.known)
        diff = np.flatnonzero(self.before[:short] != m[:short]) if short else np.zeros(0, np.int64)
        at = int(diff[0]) if len(diff) else short
        need = needed(len(m), c)
        grown = np.empty(len(m) + 1, np.int64)
        grown[: at + 1] = self.count[: at + 1]
        alive = need <= min(len(m), c)
        while alive and at < len(m):
            to = min(len(m), at + 128)
            spot = np.searchsorted(center, m[at:to])
            hit = (spot < c) & (center[np.minimum(spot, c - 1)] == m[at:to])
            grown[at + 1 : to + 1] = grown[at] + np.cumsum(hit)
            at = to
            # what the set and the centre still have beyond this shingle
            alive = grown[at] + min(len(m) - at, c - int(spot[-1])) >= need
        self.before, self.count, self.known = m.copy(), grown, at
        return bool(alive and grown[at] >= need)


def trie_overlaps(center: np.ndarray, members: list[np.ndarray]) -> list[bool]:
    """Which members (ordered sets, in lexicographic order) reach the overlap needed with ``center``."""
    walk = TrieWalk(center)
    return [walk(m) for m in members]


def classes_and_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rid, key, n, digest) of every row, (cls, digest, of, first) of every class, and (node, root) of the linked classes."""
    level = _common(docs, docs.count())
    docs = docs.withColumn("h", F.xxhash64("text"))
    lead = stage_table(_leads(docs, level))
    groups, classes = classes_of(lead)
    shared = stage_table(_shared(classes))
    check = lambda pairs: linked(pairs, classes, docs, lambda texts: ordered_sets(texts, level), TrieWalk)
    return lead, groups, components_of(shared.select("bucket", "cls"), _stars(shared), classes, check)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest doc_id it reaches by links).

    Null, empty and blank texts have no shingles and link to nothing; a text of fewer words than a shingle is one
    shingle. Rows with equal sets are linked, repeated rows included; a row with a null key keeps a null component_id
    unless it has links. An empty table gives an empty result. Shingles are 64-bit hashes, classes 128-bit digests.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return component_rows(*classes_and_links(rows))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, the first by doc_id (null last), and every row without shingles, as they came.

    Rows are told apart by a number of their own, so repeated and null ids, and repeated rows, lose no other text.
    """
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    held = stage_table(docs.withColumn(name, F.monotonically_increasing_id()))
    lead, groups, comps = classes_and_links(held.select(F.col(name).alias("rid"), F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text")))
    first = hot_join(lead.filter("n > 0").select("rid", "digest"), joined_classes(groups, comps), "digest", least=200)
    gone = stage_table(first.filter(F.col("rid") != F.col("first.rid")).select(F.col("rid").alias(name)))
    return held.join(F.broadcast(gone) if gone.count() * 16 <= BROADCAST else gone, name, "left_anti").select(docs.columns)
