"""Packing into sequences of a fixed length whose token mixture is controlled.

Every source is a queue of its documents' tokens, and a deficit round-robin serves them: each sequence takes from each
queue its share of the sequence's tokens, and what a whole number of tokens leaves over is the queue's deficit, carried
into the next sequence. Queues are served through a balanced tree in which every inner node shares its tokens between
two sides; of its first n tokens, round(n * a / (a + b)) go left (a, b: what the sides hold), so the deficit has a closed
form and is exact across sequences and tasks: no task waits for the one before. Every sequence but the last is full, and
a queue is within one token per level of the tree of its target all the time.

By default the targets are the queues' own shares, and all run out together. With ``weights``, when a queue runs out the
others share its place in their proportions; queues without a weight come last.

Every source is a queue of its own, however many there are. Documents are sorted by (queue, a hash of id and text, id)
over all tasks, so a queue's order does not depend on how the input was split. They are tokenised once and staged with
their place in their queue within their partition; one sum per (partition, queue) gives the places over all partitions.
A task then cuts its documents at the sequences' borders. Nothing but the table of queues meets on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.bpe import encoder
from riskframe.llm.common import give_back
from riskframe.session import stage

LENGTH = 2048
QUEUES = 1024  # beyond, the table of queues is sent to an executor once instead of with each task
END_ID = 1
BATCH = 256
BROADCAST_ROWS = 2_000_000  # (partition, queue) sums of about 24 bytes


class Service:
    """Tokens that queue s has been served when n tokens in all have been: ``served``; and those of queues before s.

    Queue i of weight w has had min(total, w * t) tokens at the service's time t, so a queue runs out at total / w, and
    what an inner node has had is a line that bends where one of its queues runs out. A node keeps those bends: tokens of
    its own before the bend, and what of the node and of its left side had run out and was still served. The number of
    bends of a level is that of the queues at most, and one a node where all run out together.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        self.total = sum(totals)
        scaled = self._whole(weights) if weights else list(totals)
        self.size = 1 << max(0, (len(totals) - 1).bit_length())
        # products of two counts must fit a long; beyond, Python's integers
        self.kind = np.int64 if 2 * self.total * max(1, sum(scaled)) < 2**62 else object
        first = [n if w else 0 for n, w in zip(totals, scaled)]
        last = [0 if w else n for n, w in zip(totals, scaled)]
        self.phases = [(at, sum(part), self._tree(part, w)) for at, part, w in ((0, first, scaled), (sum(first), last, last)) if any(part)]

    def _whole(self, weights: list[float]) -> list[int]:
        """Weights as integers in proportion, positive ones at least 1; in longs if that leaves 2**20 steps a queue."""
        most = 2**60 // max(1, self.total)
        unit = (most if most >= len(weights) << 20 else 2**60) - len(weights)
        every = sum(Fraction(w) for w in weights if w > 0)
        return [max(1, int(Fraction(w) * unit / every)) if w > 0 else 0 for w in weights]

    def _tree(self, part: list[int], weight: list[int]) -> list[tuple[np.ndarray, ...]]:
        """Per level, from the root's: each node's first bend, and of all bends (own tokens, run out, rate, the left side's)."""
        out_at = {i: Fraction(n, weight[i]) for i, n in enumerate(part) if n}
        ends, levels = sorted(out_at, key=out_at.get), []
        for level in range(self.size.bit_length() - 2, -1, -1):
            count = 1 << (self.size.bit_length() - 2 - level)
            held: list[list[int]] = [[] for _ in range(count)]
            for i in ends:
                held[i >> (level + 1)].append(i)
            first, rows = [], []
            for own in held:
                first.append(len(rows))
                done = gone = 0
                rate, left = sum(weight[i] for i in own), sum(weight[i] for i in own if not (i >> level) & 1)
                start = 0
                for at, i in enumerate(own):
                    if not at or out_at[i] != out_at[own[at - 1]]:
                        rows.append((start, done, rate, gone, left))
                    done, rate = done + part[i], rate - weight[i]
                    if not (i >> level) & 1:
                        gone, left = gone + part[i], left - weight[i]
                    # the node's tokens when i runs out, rounded up: from them on the next line holds
                    start = done - (-rate * part[i] // weight[i])
            first.append(len(rows))
            table = np.array(rows, object).reshape(-1, 5).T
            levels.append((first, *[c.astype(np.int64) if not len(c) or max(c) < 2**62 else c for c in table]))
        return levels

    def served(self, s: int, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(by queue s, by all queues before it) of the first n tokens; both never fall as n grows."""
        n = np.asarray(n).astype(self.kind)
        own, before = n * 0, n * 0
        for at, length, tree in self.phases:
            here = np.minimum(np.maximum(n - at, 0), length)
            if not len(here) or not here.max():
                break
            node = 0
            for level, (first, start, done, rate, gone, left) in zip(range(self.size.bit_length() - 2, -1, -1), tree):
                a, b = first[node], first[node + 1]
                if a == b:
                    part = here * 0
                elif b == a + 1:
                    part = int(gone[a]) + self._share(here - int(done[a]), int(left[a]), int(rate[a]))
                else:
                    i = a + np.maximum(np.searchsorted(start[a:b], here.astype(start.dtype), side="right") - 1, 0)
                    part = gone[i].astype(self.kind) + self._share(here - done[i].astype(self.kind), left[i].astype(self.kind), rate[i].astype(self.kind))
                if (s >> level) & 1:
                    before, here, node = before + part, here - part, 2 * node + 1
                else:
                    here, node = part, 2 * node
            own = own + here
        return own, before

    @staticmethod
    def _share(n: np.ndarray, left, rate) -> np.ndarray:
        """n * left / rate, halves rounded up."""
        return (2 * n * left + rate) // (2 * rate)

    def windows(self, s: int, lo: int, hi: int, length: int) -> tuple[int, np.ndarray, np.ndarray]:
        """First window that holds token ``lo`` of queue s, the borders up to ``hi``, and s's offset in each window."""

        def first(goal: int) -> int:  # the last window border at or below ``goal``
            a, b = 0, -(-self.total // length)
            while a < b:  # many borders are tried in one call
                tried = np.unique(np.linspace(a + 1, b, min(b - a, 64)).astype(np.int64))
                k = int(np.searchsorted(self.served(s, tried * length)[0].astype(np.int64), goal, side="right"))
                a, b = int(tried[k - 1]) if k else a, int(tried[k]) - 1 if k < len(tried) else b
            return a

        w0, w1 = first(lo), first(hi - 1) + 1
        own, before = self.served(s, np.arange(w0, w1 + 1) * length)
        return w0, own.astype(np.int64), np.diff(before).astype(np.int64)


def _tokenised(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, queue, n, raw ids with the end id, part, place): place counts tokens of the queue before, in the part."""

    def work(batches: Iterator[pa.RecordBatch]):
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], enc.kind).tobytes()
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                raw = [r + end for r in enc.encode_batch(b.column("text").to_pylist())]
                n, queues, place = [len(r) // enc.width for r in raw], b.column("queue").to_pylist(), []
                for q, k in zip(queues, n):
                    place.append(seen.get(q, 0))
                    seen[q] = place[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(queues, pa.string()), pa.array(n, pa.int64()), pa.array(raw, pa.binary()), pa.array([part] * len(n), pa.int32()), pa.array(place, pa.int64())],
                    names=["doc_id", "queue", "n", "raw", "part", "place"],
                )
        give_back()

    return docs.mapInArrow(work, "doc_id long, queue string, n long, raw binary, part int, place long")


def _pieces(rows: DataFrame, names: list[str], totals: list[int], weights: list[float] | None, length: int) -> DataFrame:
    table = (Service(totals, weights), {q: i for i, q in enumerate(names)})
    many = rows.sparkSession.sparkContext.broadcast(table) if len(names) > QUEUES else None
    table = None if many else table

    def work(batches: Iterator[pa.RecordBatch]):
        service, index = table or many.value
        encoder.cache_clear()  # no text is encoded any more, and a worker's store of pieces outlives its task
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                doc, raw = b.column("doc_id").to_pylist(), b.column("raw").to_pylist()
                n, start = b.column("n").to_numpy(), b.column("start").to_numpy()
                queues = b.column("queue").to_pylist()
                queue = np.array([index[q] for q in queues])
                out: list[list] = [[] for _ in range(8)]
                for s in np.unique(queue):
                    at = np.flatnonzero(queue == s)
                    at = at[np.argsort(start[at], kind="stable")]
                    breaks = np.flatnonzero(start[at][1:] != (start[at] + n[at])[:-1]) + 1
                    for run in np.split(at, breaks):  # documents that follow each other in the queue
                        _cut(service, int(s), queues[run[0]], run, doc, raw, n, start, length, out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate([*out[:7], [q or None for q in out[7]]])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
                )
        give_back()

    return rows.mapInArrow(work, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")


def _cut(service, s, name, run, doc, raw, n, start, length, out) -> None:
    lo, hi = int(start[run[0]]), int(start[run[-1]] + n[run[-1]])
    w0, border, shift = service.windows(s, lo, hi, length)
    heads = np.unique(np.concatenate([start[run], border[(border > lo) & (border < hi)]]))
    tails = np.append(heads[1:], hi)
    d = np.searchsorted(start[run], heads, side="right") - 1
    w = np.searchsorted(border, heads, side="right") - 1
    width = len(raw[run[0]]) // int(n[run[0]])
    ids = memoryview(np.frombuffer(b"".join([raw[i] for i in run]), f"<u{width}").astype("<u4").tobytes())
    out[0].extend([doc[run[x]] for x in d])
    out[1].extend((heads - start[run][d]).tolist())
    out[2].extend((tails - heads).tolist())
    out[3].extend([zlib.crc32(ids[4 * (a - lo) : 4 * (z - lo)]) for a, z in zip(heads.tolist(), tails.tolist())])
    out[4].extend(n[run][d].tolist())
    out[5].extend((w + w0).tolist())
    out[6].extend((shift[w] + heads - border[w]).tolist())
    out[7].extend([name] * len(heads))


def pack(docs: DataFrame, tokenizer: str, weights: dict[str | None, float] | None = None, length: int = LENGTH, text: str = "text", key: str = "doc_id", source: str = "source", order: list[str] | None = None) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    Null texts count as empty and hold the end id alone. Within a queue, documents follow a hash of id and text, then the
    id. A source is a queue, and a null source one of its own. ``weights`` are the queues' target shares of the tokens
    (relative; None is the null source's). Repeated rows are documents of their own; an empty table gives an empty result.
    ``order`` names columns that the documents of a queue follow first, as a mix has placed them.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    turn = [F.col(c).alias(f"turn{i}") for i, c in enumerate(order or [])]
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), name.alias("queue"), *turn)
    line = ["queue", *[f"turn{i}" for i in range(len(turn))], F.xxhash64("doc_id", "text"), "doc_id"]
    rows = rows.repartitionByRange(*line).sortWithinPartitions(*line).select("doc_id", "text", "queue")
    staged = stage(_tokenised(rows, tokenizer))
    sums = stage(staged.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = sorted((r["queue"], r["n"]) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    if not totals:
        return docs.sparkSession.createDataFrame([], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
    small = sums.count() <= BROADCAST_ROWS
    placed = staged.join(F.broadcast(bases) if small else bases, ["queue", "part"]).select("doc_id", "queue", "n", "raw", (F.col("place") + F.col("base")).alias("start"))
    given = [float(weights.get(q[1:] if q else None, 0)) for q, _ in totals] if weights else None
    out = _pieces(placed, [q for q, _ in totals], [n for _, n in totals], given, length)
    return out.withColumn("queue", F.expr("CASE WHEN queue LIKE '=%' THEN substr(queue, 2) ELSE queue END"))
