"""Prefix trie of conversations, by union-find over the LCP edges of sorted neighbours.

A conversation is the sequence of its turns, each as 16 bytes of a digest of role and text, so sorting the byte strings puts
conversations with a common beginning next to each other, and the longest common prefix (LCP) of two neighbours is
the depth of the node where they part.

1. The sequences are range-partitioned and sorted, equal ones by id, so a sequence that a third of all conversations
   share is many partitions.
2. In a partition, the edges between neighbours are united in descending depth. Neighbours only, so the components are
   runs, and a stack holds those that are open: an edge of depth d first closes all that are deeper, and a merge makes
   the branching node at d. Between two branching nodes each turn is a node of one child.
3. Nodes on the path of a partition's first or last sequence may go on next door. They leave as two contracted
   sequences, the tips, with sums per depth; all others are whole. Tips of ``FAN`` adjacent partitions meet in one task,
   where the same stack unites them, and so on until one is left.
4. A node that closes after its child has left is met by a join on (round, task, node): the rows of one task at most.
5. The ids that end in a node are written in pieces in order, and hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stage_table
from riskframe.session import shuffle_partitions

WIDTH = 16  # bytes of a turn in a sequence
GROUP = 20  # conversations that share a beginning
FAN = 32  # partitions whose tips meet in one task
PIECE = 50_000  # ids of one node in a row
WAITING = 20_000  # children that wait for their parent in a worker

WORD = r"[^\x20\x09-\x0D]+"

#: kind: node (closed), tip, on (an open node of the task, for children that have left), ends (ids that end in a node)
_DDL = (
    "kind string, task int, side int, path binary, words array<long>, low array<long>, n array<long>, ended array<long>, kids array<long>, leaves array<long>, saved array<long>, "
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent_at binary, piece string"
)
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in _DDL.split(", "))])
_NONE = dict.fromkeys(_SCHEMA.names)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words): every conversation's rebuilt sequence, and the words of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # the length tells where the role ends
    turn = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    each = turns.filter("conv_id IS NOT NULL").select("conv_id", F.struct("turn", "role", turn.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("t"))
    own = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    first = own.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, 3).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    both = own.withColumn("base", base).withColumn("h", h).join(first, "base", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("first", F.array()), 1, F.greatest("h", F.lit(1)))).otherwise(F.slice("own", 1, 0))
    full = F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return both.select("conv_id", full.alias("t")).select("conv_id", F.unhex(F.array_join("t.id", "")).alias("path"), F.col("t.words").alias("words"))


def common_turns(x: bytes, y: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    lo, hi = 0, min(len(x), len(y)) // WIDTH
    if x[: hi * WIDTH] == y[: hi * WIDTH]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[: mid * WIDTH] == y[: mid * WIDTH]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class _Node:
    """An open node: sums over what has closed below it and what ends in it."""

    __slots__ = ("ended", "first", "kids", "leaves", "left", "low", "n", "pieces", "saved", "wait", "words")

    def __init__(self, words: int, left: bool):
        self.words, self.left = words, left  # left: on the path of the task's first sequence
        self.low, self.n, self.ended, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0, 0
        self.wait: list[dict] = []
        self.first = False  # whether a child has left with this node still open
        self.pieces: list[int] = []


class Forest:
    """The nodes of one run of sorted sequences; rows of what closes, and the tips of what may go on outside."""

    def __init__(self, task: int, whole: bool):
        self.task, self.whole = task, whole  # whole: nothing lies outside this run
        self.path, self.stack, self.rows, self.start = b"", [], [], None

    def _row(self, **what) -> None:
        self.rows.append({**_NONE, "task": self.task, **what})

    def _ends(self, node: _Node, depth: int) -> None:
        if node.pieces:
            self._row(kind="ends", path=self.path[: depth * WIDTH], conv_id=node.pieces[0], piece=",".join(map(str, node.pieces)))
            node.pieces = []

    def _leave(self, node: _Node, depth: int) -> None:
        """Children that wait go out without their parent's id."""
        for row in node.wait:
            self._row(**row, parent_at=self.path[: depth * WIDTH])
        node.first |= bool(node.wait)
        node.wait = []

    def _close(self) -> None:
        """The deepest open node merges into the one above it."""
        node, depth = self.stack.pop(), len(self.stack)
        if node.left and not self.whole:  # may have begun next door: its sums stay with the tip
            self._ends(node, depth)
            self._leave(node, depth)
            self.start[depth] = node
            return
        if not node.kids:
            node.leaves = 1
        node.saved += (node.n - 1) * node.words
        sha = None
        if node.ended == len(node.pieces):  # all that end here are at hand
            sha = hashlib.sha256(",".join(map(str, node.pieces)).encode()).hexdigest() if node.pieces else _EMPTY_SHA
        else:
            self._ends(node, depth)
        row = {"conv_id": node.low, "depth": depth, "n_convs": node.n, "n_children": node.kids, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": sha, "path": self.path[: depth * WIDTH], "kind": "node"}
        for child in node.wait:
            self._row(**child, parent_conv_id=node.low)
        if node.first:
            self._row(kind="on", path=row["path"], conv_id=node.low)
        if not self.stack:
            self._row(**row)
            return
        up = self.stack[-1]
        up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + node.leaves, up.saved + node.saved
        up.n, up.low = up.n + node.n, node.low if up.low is None else min(up.low, node.low)
        up.wait.append(row)
        if len(up.wait) > WAITING:
            self._leave(up, depth - 1)

    def open(self, path: bytes, words: list[int]) -> None:
        """Close all that the next sequence does not share, and open the rest of its turns."""
        keep = common_turns(self.path, path) if self.stack else 0
        while len(self.stack) > keep + 1:
            self._close()
        first = not self.stack
        if first:
            self.start = [None] * (len(words) + 1)
        self.path = path
        for d in range(len(self.stack), len(words) + 1):
            self.stack.append(_Node(words[d - 1] if d else 0, first))

    def add(self, path: bytes, words: list[int], conv_id: int) -> None:
        self.open(path, words)
        node = self.stack[-1]
        node.low = conv_id if node.low is None else min(node.low, conv_id)
        node.n, node.ended = node.n + 1, node.ended + 1
        node.pieces.append(conv_id)
        if len(node.pieces) >= PIECE:
            self._ends(node, len(self.stack) - 1)

    def add_tip(self, tip: dict) -> None:
        """A contracted sequence: its sums go to its nodes."""
        self.open(tip["path"], tip["words"])
        for d, node in enumerate(self.stack):
            if tip["low"][d] is not None:
                node.low = tip["low"][d] if node.low is None else min(node.low, tip["low"][d])
            node.n, node.ended, node.kids = node.n + tip["n"][d], node.ended + tip["ended"][d], node.kids + tip["kids"][d]
            node.leaves, node.saved = node.leaves + tip["leaves"][d], node.saved + tip["saved"][d]
            # a child may have left with it: the rows of tasks below name this node by their own round and task

    def finish(self) -> None:
        if not self.stack:
            return
        if self.whole:
            while self.stack:
                self._close()
            return
        right, path = self.stack, self.path
        for d, node in enumerate(right):
            self._ends(node, d)
            self._leave(node, d)
            if node.left:
                self.start[d] = node
        shared = sum(node.left for node in right)
        self._tip(0, self.first_path, self.first_words, self.start, 0)
        if shared < len(right):
            self._tip(1, path, self.last_words, right, shared)

    def _tip(self, side: int, path: bytes, words: list[int], nodes: list[_Node], since: int) -> None:
        at = lambda f, none: [getattr(x, f) if d >= since else none for d, x in enumerate(nodes)]
        self._row(kind="tip", side=side, path=path, words=words, low=at("low", None), **{f: at(f, 0) for f in ("n", "ended", "kids", "leaves", "saved")})
        for d, node in enumerate(nodes):
            if d >= since and node.first:
                self._row(kind="on", path=path[: d * WIDTH])


def _batches(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _round(rows: DataFrame, tips: bool, whole: bool) -> DataFrame:
    """Forests of the runs: one per partition of conversations, or one per ``group`` of tips."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            for r in b.to_pylist():
                task = r["group"] if tips else TaskContext.get().partitionId()
                if now is None or now.task != task:
                    if now is not None:
                        now.finish()
                        yield _batches(now.rows)
                    now = Forest(task, whole)
                    now.first_path, now.first_words = r["path"], r["words"]
                now.last_words = r["words"]
                if tips:
                    now.add_tip(r)
                else:
                    now.add(r["path"], r["words"], r["conv_id"])
                if len(now.rows) >= 10_000:
                    yield _batches(now.rows)
                    now.rows = []
        if now is not None:
            now.finish()
            yield _batches(now.rows)

    return rows.mapInArrow(work, _DDL)


def trie(turns: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), equal ones by role and digest; a null role or text is empty; turns without a
    conversation id belong to no conversation and are left out. The remainder of a negative id is that of SQL.
    An empty table gives no node. Other columns are ignored. Turns are told apart by 128-bit digests; one conversation's
    sequence, 16 bytes a turn, is one row.
    """
    n = tasks or shuffle_partitions(turns.sparkSession)
    seqs = stage_table(rebuilt(turns))
    sorted_ = seqs.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    whole = n == 1
    rounds = [stage_table(_round(sorted_, False, whole))]
    last = None if whole else rounds[0].agg(F.max("task").alias("t")).first()["t"]  # range partitions may be fewer or more than asked for
    while last is not None and not whole:
        last //= FAN
        whole = last == 0
        tips = rounds[-1].filter("kind = 'tip'").withColumn("group", F.floor(F.col("task") / FAN).cast("int"))
        dealt = tips.select("group", "task", "side", "path", "words", "low", "n", "ended", "kids", "leaves", "saved").repartition("group").sortWithinPartitions("group", "task", "side")
        rounds.append(stage_table(_round(dealt, True, whole)))
    all_ = None
    for i, r in enumerate(rounds):
        r = r.withColumn("round", F.lit(i))
        all_ = r if all_ is None else all_.unionByName(r)
    stats = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = all_.filter("kind = 'node'").select("round", "task", "path", "conv_id", "depth", "parent_conv_id", *stats, "ends_sha256", "parent_at")
    # ids that end in a node of several tasks: streamed in order
    late = nodes.filter("ends_sha256 IS NULL").select("path")
    shas = _digests(all_.filter("kind = 'ends'").select("path", "conv_id", "piece"), late)
    # parents that closed after their children had left
    closed = nodes.filter("round > 0").select("path", F.col("conv_id").alias("late_id")).unionByName(all_.filter("kind = 'on' AND conv_id IS NOT NULL AND round = 0").select("path", F.col("conv_id").alias("late_id")))
    known = all_.filter("kind = 'on'").select("round", "task", "path").distinct().join(closed, "path").select("round", "task", F.col("path").alias("parent_at"), "late_id")
    out = nodes.join(known, ["round", "task", "parent_at"], "left").join(shas, "path", "left")
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", "late_id").alias("parent_conv_id"), *stats, F.coalesce("ends_sha256", "late_sha").alias("ends_sha256"))


def _digests(ends: DataFrame, late: DataFrame) -> DataFrame:
    """(path, late_sha) of the ids that end in the nodes ``late``; each node's pieces pass through one task as a stream."""

    def work(batches):
        now, sha, rows = None, None, []
        for b in batches:
            for path, piece in zip(b.column("path").to_pylist(), b.column("piece").to_pylist()):
                if path != now:
                    if now is not None:
                        rows.append((now, sha.hexdigest()))
                    now, sha = path, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
        if now is not None:
            rows.append((now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.string())], names=["path", "late_sha"])

    dealt = ends.join(late, "path", "left_semi").repartition("path").sortWithinPartitions("path", "conv_id")
    return dealt.select("path", "piece").mapInArrow(work, "path binary, late_sha string")
