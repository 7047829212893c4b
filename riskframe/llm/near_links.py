"""Links between sets that share buckets, without the pairs of a bucket: blocks of set sketches, and exact checks.

Sets are classes of documents with equal shingles. A sketch counts a set's shingles by hash; the sum of the smaller counts of
two sketches is never below the sets' overlap, so a pair whose sum is too small has no link. Sketches of a bucket meet
in blocks of bounded size inside a task; only pairs that the bound admits, of different components, leave it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import give_back, stage_table, text_steps
from riskframe.operators.components import components
from riskframe.operators.joins import hot_join, tasks_for

PERCENT = 80
STEP = 1_000_000  # characters per step, bounds the arrays in a worker
BLOCK = 512  # sets of one bucket that meet the others in one unit
PART = 256  # sets checked against one by one unit
WANTED = 64 << 20  # bytes of the broadcast list of rows whose sets are needed
SEEN = 500_000  # pairs that a task remembers, so that it tells few of them twice
HOT = 200  # rows of a key below which it is never hot


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def sketch(values: np.ndarray, least: int = 64, most: int = 8192) -> bytes | None:
    """Counts of a set's shingles in a power of two of bins, twice as many as shingles or more; None where one is over a byte."""
    bins = min(most, max(least, 2 << max(0, int(len(values) - 1).bit_length())))
    counts = np.bincount((values & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    if counts.max(initial=0) > 255:
        return None
    pack = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)  # the counts are small: two bits a bin
    return pack.compress(counts.astype(np.uint8).tobytes()) + pack.flush()


def unpacked(s: bytes | None) -> bytes | None:
    return None if s is None else zlib.decompress(s, -15)


def most_shared(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Sums of the smaller counts of every unpacked sketch of ``x`` with every one of ``y``; the finer is folded to the other's bins.

    min(a, b) is the number of t from 1 with a >= t and b >= t, so the sums are a few matrix products.
    """
    out = np.empty((len(x), len(y)), np.float32)
    for n in {len(s) for s in x}:
        i = [k for k, s in enumerate(x) if len(s) == n]
        a = np.frombuffer(b"".join([x[k] for k in i]), np.uint8).reshape(len(i), n)
        for m in {len(s) for s in y}:
            j = [k for k, s in enumerate(y) if len(s) == m]
            b = np.frombuffer(b"".join([y[k] for k in j]), np.uint8).reshape(len(j), m)
            bins = min(n, m)
            p, q = (z.reshape(len(z), -1, bins).sum(axis=1, dtype=np.int32) for z in (a, b))
            total = np.zeros((len(i), len(j)), np.float32)
            for t in range(1, int(min(p.max(initial=0), q.max(initial=0))) + 1):
                total += (p >= t).astype(np.float32) @ (q >= t).astype(np.float32).T
            out[np.ix_(i, j)] = total
    return out


def _admitted(rows: list[tuple], best: bool) -> Iterator[tuple[int, int]]:
    """Pairs of classes of different components that the bound admits, of one unit; each set's ``best`` one only."""
    parts = [[r for r in rows if r[0] == s] for s in (0, 1)]
    left, right = parts if parts[1] else (parts[0], parts[0])
    if not left or len({r[2] for r in rows}) < 2:
        return
    drawn = [[unpacked(r[4]) for r in p] for p in (left, right)]
    known = [[x is not None for x in p] for p in drawn]
    cls, comp, n = ([np.array([r[k] for r in p], np.int64) for p in (left, right)] for k in (1, 2, 3))
    most = np.minimum.outer(n[0], n[1]).astype(np.float32)
    if any(known[0]) and any(known[1]):
        ix = np.ix_(*known)
        most[ix] = np.minimum(most[ix], most_shared(*[[x for x in p if x is not None] for p in drawn]))
    total = np.add.outer(n[0], n[1])
    fits = (most * (100 + PERCENT) >= total * PERCENT) & (comp[0][:, None] != comp[1][None, :])
    if not fits.any():
        return
    i, j = np.nonzero(fits)
    if best:
        share = np.where(fits, most / total, -1.0)
        top = np.zeros_like(fits)
        top[np.arange(len(left)), share.argmax(axis=1)] = True
        top[share.argmax(axis=0), np.arange(len(right))] = True
        i, j = np.nonzero(fits & top)
    yield from set(zip(np.minimum(cls[0][i], cls[1][j]).tolist(), np.maximum(cls[0][i], cls[1][j]).tolist()))


def open_pairs(rows: DataFrame, best: bool) -> DataFrame:
    """Distinct pairs (a, b) from ``rows`` (bucket, m, cls, comp, n, sketch); m: how many rows the bucket has.

    A bucket of more than ``BLOCK`` sets is cut into blocks, and every two blocks are a unit of their own.
    """
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = rows.withColumn("x", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), (F.col("x") > F.col("y")).cast("int").alias("side"), "cls", "comp", "n", "sketch")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, seen = None, [], set()

        def fresh():
            found = [p for p in _admitted(rows, best) if p not in seen]
            if len(seen) > SEEN:
                seen.clear()
            seen.update(found)
            return found

        def told(out):
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for b in batches:
            out = []
            for bucket, lo, hi, *r in zip(*(c.to_pylist() for c in b.columns)):
                if (bucket, lo, hi) != now:
                    out += fresh()
                    now, rows = (bucket, lo, hi), []
                rows.append(tuple(r))
            yield told(out)
        yield told(fresh())
        rows, seen, b = [], set(), None
        give_back()

    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(work, "a long, b long").distinct()


Sets = Callable[[list[str]], tuple[np.ndarray, np.ndarray, list[bytes | None]]]  # of texts: values, bounds, digests


def linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, sets: Sets, against: Callable[[np.ndarray], Callable[[np.ndarray], bool]]) -> DataFrame:
    """The pairs (a, b), a staged table, whose whole sets are similar enough.

    The text of one document of each class (cls, key, h, digest) is read again, and its set goes to the units that need
    it. ``against`` takes a set and gives the check of others. The sets checked against one are dealt out in parts of
    about ``PART``; a unit holds that one, and the others stream by in lexicographic order.
    """
    tasks = tasks_for(pairs.count())
    pairs = pairs.coalesce(tasks)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")).coalesce(tasks)
    met = pairs.join(many, "a") if tasks == 1 else hot_join(pairs, many, "a", least=HOT)
    placed = met.select(F.col("b").alias("cls"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    centers = many.select(F.col("a").alias("cls"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # a class that very many units need is read once for each of 16 shares of them
    share = F.pmod(F.xxhash64("a", "part"), F.lit(16))
    to = placed.unionByName(centers).coalesce(tasks).groupBy("cls", share.alias("share")).agg(F.collect_list(F.struct("a", "part")).alias("to"))
    want = stage_table(to.join(classes.select("cls", F.col("key").alias("k"), F.col("h").alias("th"), F.col("digest").alias("want")), "cls").drop("share"))
    size = want.agg(F.count("*").alias("n"), F.sum(F.size("to")).alias("units")).first()
    if size["n"] * 80 + (size["units"] or 0) * 16 <= WANTED:
        want = F.broadcast(want)
    chosen = docs.join(want, (F.col("h") == F.col("th")) & F.col("key").eqNullSafe(F.col("k"))).select("cls", "want", "to", "text")
    to_schema = "to array<struct<a:long,part:int>>"

    def fetch(batches):
        for b in text_steps(batches, STEP):
            values, bounds, ids = sets(b.column("text").to_pylist())
            same = [x == w for x, w in zip(ids, b.column("want").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("cls"), b.column("to"), lists(values, bounds)], names=["cls", "to", "items"]).filter(pa.array(same, pa.bool_()))

    rows = chosen.mapInArrow(fetch, f"cls long, {to_schema}, items array<long>").select(F.explode("to").alias("t"), "cls", "items")
    rows = rows.select("t.a", "t.part", "cls", "items", (F.col("cls") != F.col("t.a")).alias("other"))
    dealt = rows.repartition("a", "part").sortWithinPartitions("a", "part", "other", "items")

    def work(batches):
        now, check = None, None
        for batch in batches:
            out = ([], [])
            items = batch.column("items")
            values, offs = items.values.to_numpy(), items.offsets.to_numpy()
            for i, (a, part, c, other) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("a", "part", "cls", "other")))):
                mine = values[offs[i] : offs[i + 1]]
                if not other:
                    now, check = (a, part), against(mine.copy())
                elif now == (a, part) and check(mine):
                    out[0].append(a), out[1].append(c)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
        now = check = batch = items = values = offs = None
        give_back()

    return dealt.mapInArrow(work, "a long, b long")


def classes_of(lead: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, digest, of, first) of the classes of rows (rid, key, n, digest), and one row of each with its other columns.

    ``first`` is the row of the smallest id, as (no id, key, rid). The other rows of a class are left out by a list of
    their numbers, so nothing wide is moved or written.
    """
    first = F.min(F.struct(F.isnull("key").alias("none"), "key", "rid")).alias("first")
    some = lead.filter("n > 0")
    groups = stage_table(some.groupBy("digest").agg(F.min("rid").alias("cls"), F.count("*").alias("of"), first))
    extra = stage_table(hot_join(some.select("rid", "digest"), groups.filter("of > 1").select("digest", "cls"), "digest", least=HOT).filter("rid <> cls").select("rid"))
    extra = F.broadcast(extra) if extra.count() * 16 <= WANTED else extra
    return groups, some.join(extra, "rid", "left_anti").withColumnRenamed("rid", "cls")


def _opened(shared: DataFrame, classes: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the buckets that more than one component holds, with component and sketch; of buckets that hold the same
    classes, one."""
    tasks = tasks_for(shared.count())
    rows = shared.join(comps.select(F.col("node").alias("cls"), "root"), "cls", "left").select("bucket", "cls", F.coalesce("root", "cls").alias("comp"))
    rows = stage_table(rows.coalesce(tasks)).coalesce(tasks)
    who = [F.bit_xor(F.xxhash64("cls", F.lit(i))).alias(f"x{i}") for i in (1, 2)]
    of = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), *who).filter("lo <> hi")
    of = of.coalesce(tasks).groupBy("m", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket", "m").coalesce(tasks)
    return rows.join(of, "bucket").join(classes.select("cls", "n", "sketch"), "cls").select("bucket", "m", "cls", "comp", "n", "sketch")


def components_of(shared: DataFrame, pairs: DataFrame, classes: DataFrame, check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the linked classes. ``shared``: (bucket, cls); ``pairs``: the first pairs (a, b) to check.

    Links found are contracted; in buckets of several components, each set's best partner of another one is checked next,
    then, contracted again, every pair of different components that the bound admits. No link between two components is
    left out, and links within one need no check.
    """
    pairs = stage_table(pairs)
    if pairs.isEmpty():
        return shared.sparkSession.createDataFrame([], "node long, root long")
    links = stage_table(check(pairs))
    comps = components(links, "a", "b")
    for best in (True, False):
        more = open_pairs(_opened(shared, classes, comps), best)
        more = stage_table(more.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue  # the best ones may have been checked already, and hide others
        found = stage_table(check(more))
        pairs = pairs.unionByName(more)
        if not found.isEmpty():
            links = links.unionByName(found)
            comps = components(links, "a", "b")
    return comps


def joined_classes(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(digest, first) of every class of several rows or with a link; ``first`` is the first row of its component."""
    tasks = tasks_for(groups.count())
    rooted = groups.join(comps.withColumnRenamed("node", "cls"), "cls", "left").filter("of > 1 OR root IS NOT NULL")
    rooted = stage_table(rooted.select("digest", "first", F.coalesce("root", "cls").alias("root")).coalesce(tasks)).coalesce(tasks)
    lows = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return hot_join(rooted.select("digest", "root"), lows, "root", least=HOT).select("digest", "first")


def component_rows(lead: DataFrame, groups: DataFrame, comps: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    out = hot_join(lead.select("key", "n", "digest"), joined_classes(groups, comps), "digest", "left", least=HOT)
    return out.select(F.col("key").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("first.key", "key").alias("component_id"))
