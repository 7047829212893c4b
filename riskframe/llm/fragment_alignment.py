"""Links between the tokens of two tokenizers over the same bytes, by composing fragments of byte ranges.

Where a token of A and a token of B end at one byte, the text is cut; the tokens between two cuts are a group, and all A-B
pairs of a group are linked. A byte range yields a fragment: the tokens before its first cut (open prefix), the groups
between its cuts (closed) and the tokens after its last cut (open suffix). Fragments compose associatively: the suffix
of one and the prefix of the next become a group, or stay open where one of the two has no cut. A text's start and end
are cuts of both.

1. Texts up to ``CHUNK`` characters are aligned in one step. Longer ones are cut into chunks that go to tasks of their own;
   each gives a fragment, and adjacent fragments are composed by a tree of rounds, ``FAN`` at a time. Closed groups leave
   at once; only open ends and sums travel on.
2. A chunk may begin at a space between two other characters: neither tokenizer has a token across it. The same cuts
   make the words, whose tokens and groups a worker keeps in a bounded store.
3. A document's distinct id pairs are written once with their numbers, counted over the corpus, and looked up again: in a
   broadcast table of checked size (13 bytes a pair), beyond it by a join that spreads hot pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.bpe import _byte_of, _plain_bpe
from riskframe.llm.common import stage_table, text_steps
from riskframe.llm.graph import spread_join

CHUNK = 65_536  # characters; longer texts are aligned in chunks of about this size
FAN = 16  # fragments composed by one task of a round
STEP = 2_000_000  # characters aligned in one step, bounds a worker's arrays
HELD = 300_000  # words kept by a worker, about 150 MB; emptied when full
PAIRS = 5_000_000  # pairs of 13 bytes in the broadcast table, 65 MB

_CUT = re.compile(r"(?<=\S)(?= \S)")
_EDGE = re.compile(r"\s | \s|^ | $")
_HEX = re.compile(r"<0x([0-9A-F]{2})>")


# ---------------------------------------------------------------- the monoid


@dataclass
class Fragment:
    """Tokens that end in a byte range: open prefix, closed groups, open suffix. Without a cut all is prefix."""

    cut: bool = False
    head: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    groups: list[tuple[list[int], list[int]]] = field(default_factory=list)
    tail: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))


def fragment(ids_a, ends_a, ids_b, ends_b, lo: int, hi: int) -> Fragment:
    """The fragment of the tokens whose ends are in (lo, hi]; ends are byte offsets in the whole text."""
    ends_a, ends_b = np.asarray(ends_a), np.asarray(ends_b)
    a0, a1 = np.searchsorted(ends_a, [lo, hi], side="right")
    b0, b1 = np.searchsorted(ends_b, [lo, hi], side="right")
    both = np.intersect1d(ends_a[a0:a1], ends_b[b0:b1])
    at_a = [int(a0), *(np.searchsorted(ends_a, both, side="right")).tolist(), int(a1)]
    at_b = [int(b0), *(np.searchsorted(ends_b, both, side="right")).tolist(), int(b1)]
    parts = [(list(ids_a[i:j]), list(ids_b[k:m])) for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
    return Fragment(True, parts[0], parts[1:-1], parts[-1]) if len(both) else Fragment(False, parts[0])


def _joined(x, y):
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two adjacent ranges; associative, with the empty fragment as its unit."""
    if not x.cut and not y.cut:
        return Fragment(False, _joined(x.head, y.head))
    if not x.cut:
        return Fragment(True, _joined(x.head, y.head), y.groups, y.tail)
    if not y.cut:
        return Fragment(True, x.head, x.groups, _joined(x.tail, y.head))
    return Fragment(True, x.head, [*x.groups, _joined(x.tail, y.head), *y.groups], y.tail)


def group_text(group) -> str:
    return ",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1]))


def code(a, b):
    """An id pair in 32 bits; ids of both vocabularies are below 65,536."""
    return a << 16 | b


def _links(groups) -> tuple[np.ndarray, np.ndarray]:
    """(distinct pair codes, numbers of links) of groups."""
    got = [code(np.repeat(np.array(a, np.int64), len(b)), np.tile(np.array(b, np.int64), len(a))) for a, b in groups]
    return np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)


# ---------------------------------------------------------------- tokens of words


class Aligner:
    """Both tokenizers, and a bounded store of aligned words: per word its numbers, links, and groups as text ending in ``;``."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(_HEX.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = _plain_bpe(path_a)
        if plain:
            self.encode_a = lambda texts: [plain[0].encode_ordinary(t) for t in texts]
            self.bytes_a = [plain[0].decode_single_token_bytes(i) if n else b"" for i, n in enumerate(plain[1].tolist())]
        else:
            tok, byte_of = Tokenizer.from_file(path_a), _byte_of()
            tok.encode_special_tokens = True
            self.encode_a = lambda texts: [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
            self.bytes_a = [bytes(byte_of.get(c, 0) for c in tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        # an id with what follows it in the text of the groups
        self.said = [f"{i}{end}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for end in ",|;"]
        # no token of either may reach over a space between two other characters
        self.cuts = bool(plain) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.text: list[str] = []
        self.sums = np.zeros((0, 5), np.int64)  # ok, tokens of A, tokens of B, groups, links
        self.start, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """The text in parts that neither tokenizer joins; a part after the first has lost the space before it."""
        if not self.cuts:
            return [text]
        if not _EDGE.search(text):
            return text.split(" ")
        first, *rest = _CUT.split(text)
        return [first, *(w[1:] for w in rest)]

    def tokens(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(whether both tokenizers give its bytes, per word; ids of A and of B of the words where they do, and how many of each)."""
        a, b = self.encode_a([" " + w for w in words]), self.b.encode(words, num_threads=1)
        whole = [(" " + w).encode() for w in words]
        ok = np.ones(len(words), bool)
        sides = []
        for ids, size, raw in ((a, self.size_a, self.bytes_a), (b, self.size_b, self.bytes_b)):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, n.sum())
            to = np.append(0, np.cumsum(size[flat]))[np.cumsum(n)]
            if b"".join([raw[i] for i in flat.tolist()]) != b"".join(whole) or (to != np.cumsum([len(w) for w in whole])).any():
                ok &= [b"".join([raw[i] for i in x]) == w for x, w in zip(ids, whole)]
            sides.append((flat, n))
        return ok, *[x for flat, n in sides for x in (flat[np.repeat(ok, n)], n[ok])]

    def learn(self, words: list[str]) -> None:
        ok, a, na, b, nb = self.tokens(words)
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        cut_a = ends_b[np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)] == ends_a if len(a) else np.zeros(0, bool)
        cut_b = ends_a[np.minimum(np.searchsorted(ends_a, ends_b), len(ends_a) - 1)] == ends_b if len(b) else np.zeros(0, bool)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        of_a, of_b = (np.bincount(g, minlength=int(cut_a.sum())) for g in (group_a, group_b))
        up_a, up_b = np.cumsum(of_a), np.cumsum(of_b)
        # links: every token of A with each of B in its group
        n = of_b[group_a]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((up_b - of_b)[group_a], n)
        pairs = code(np.repeat(a, n), b[at])
        # the groups as text: a group's tokens of A, then of B
        said = np.empty(len(a) + len(b), np.int64)
        said[np.arange(len(a)) + (up_b - of_b)[group_a]] = 3 * a + cut_a
        said[np.arange(len(b)) + up_a[group_b]] = 3 * b + 2 * cut_b
        text = list(map(self.said.__getitem__, said.tolist()))
        per = lambda x: np.diff(np.append(0, np.append(0, np.cumsum(x))[np.cumsum(na)]))  # noqa: E731  sums over the A tokens of a word
        sums = np.zeros((len(words), 5), np.int64)
        sums[ok] = np.stack([np.ones(len(na), np.int64), na, nb, per(cut_a), per(n)], axis=1)
        ends = np.cumsum(sums[:, 1] + sums[:, 2]).tolist()
        self.at.update(zip(words, range(len(self.text), len(self.text) + len(words))))
        self.text += ["".join(text[lo:hi]) for lo, hi in zip([0, *ends], ends)]
        self.sums = np.concatenate([self.sums, sums])
        self.start = np.append(self.start, self.start[-1] + np.cumsum(sums[:, 4]))
        self.pairs = np.append(self.pairs, pairs)

    def align(self, texts: list[str]) -> list[tuple]:
        """Per text (without tokens if empty or not ok): n_a, n_b, n_groups, groups_sha256, pair codes, numbers."""
        split = [self.words(t) if t else [] for t in texts]
        at = self.at
        new = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in at]
        if new:
            self.learn(new)
        spot = [[at[w] for w in ws] for ws in split]
        flat = np.fromiter((i for s in spot for i in s), np.int64)
        ends = np.cumsum([len(s) for s in spot])
        total = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.sums[flat], axis=0)])
        total = total[ends] - total[ends - [len(s) for s in spot]]
        good = (total[:, 0] == [len(s) for s in spot]) & (total[:, 0] > 0)
        n = self.sums[flat, 4]
        where = np.arange(n.sum()) + np.repeat(self.start[flat] - (np.cumsum(n) - n), n)
        both = np.repeat(np.arange(len(texts)), total[:, 4]) << 32 | self.pairs[where]
        both, times = np.unique(both, return_counts=True)
        cut = np.searchsorted(both >> 32, np.arange(len(texts) + 1))
        out = []
        for i, s in enumerate(spot):
            if good[i]:
                said = "".join(map(self.text.__getitem__, s))[:-1]
                out.append((*total[i, 1:4].tolist(), hashlib.sha256(said.encode()).hexdigest(), both[cut[i] : cut[i + 1]] & 0xFFFFFFFF, times[cut[i] : cut[i + 1]]))
            else:
                out.append((0, 0, 0, "", both[:0], times[:0]))
        if len(at) > HELD:
            self.clear()
        return out

    def chunk(self, text: str) -> tuple[bool, Fragment]:
        """(whether both tokenizers give the bytes, the fragment) of a chunk that begins after a cut's space."""
        ok, a, _, b, _ = self.tokens(self.words(text))
        if not ok.all():
            return False, Fragment()
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        return True, fragment(a.tolist(), ends_a, b.tolist(), ends_b, 0, int(ends_a[-1]))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def chunks(text: str, size: int) -> Iterator[str]:
    """The text in chunks of ``size`` characters or more, each up to the next cut, without the space that begins it."""
    lo, shift = 0, 0
    while True:
        cut = _CUT.search(text, min(lo + size, len(text)))
        yield text[lo + shift : cut.start() if cut else len(text)]
        if not cut:
            return
        lo, shift = cut.start(), 1


# ---------------------------------------------------------------- Spark

_LISTS = "pairs array<int>, times array<int>"
_PART = "lo int, cut boolean, head_a array<int>, head_b array<int>, tail_a array<int>, tail_b array<int>, ok boolean, n_a long, n_b long"


def _codes(x: np.ndarray):
    return x.astype(np.uint32).view(np.int32)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _aligned(docs: DataFrame, paths: tuple[str, str], size: int) -> DataFrame:
    """Per short text its whole result; per long text its chunks (``no`` is not null)."""
    ddl = f"rid long, doc_id long, no int, text string, n_a long, n_b long, n_groups long, groups_sha256 string, {_LISTS}"

    def work(batches):
        schema, al = _arrow(ddl), aligner(*paths)
        for b in text_steps(batches, STEP):
            short, long = [], []
            for rid, d, t in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "text"))):
                (long if t and len(t) > size and al.cuts else short).append((rid, d, t))
            got = al.align([t for _, _, t in short])
            yield _batch([(rid, d, None, None, na, nb, ng, sha, _codes(p), k.astype(np.int32)) for (rid, d, _), (na, nb, ng, sha, p, k) in zip(short, got)], schema)
            for rid, d, t in long:
                for i, part in enumerate(chunks(t, size)):
                    yield _batch([(rid, d, i, part, 0, 0, 0, "", [], [])], schema)

    return docs.mapInArrow(work, ddl)


def _fragments(parts: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Per chunk its fragment, and its closed groups as text and links."""
    ddl = f"rid long, no int, {_PART}, sub int, groups string, n_groups long, {_LISTS}"

    def work(batches):
        schema, al = _arrow(ddl), aligner(*paths)
        for b in batches:
            for rid, no, t in zip(*(b.column(c).to_pylist() for c in ("rid", "no", "text"))):
                ok, f = al.chunk(t)
                pairs, times = _links(f.groups)
                n = [len(f.head[i]) + len(f.tail[i]) + sum(len(g[i]) for g in f.groups) for i in (0, 1)]
                yield _batch([(rid, no, no, f.cut, *f.head, *f.tail, ok, *n, 1, ";".join(map(group_text, f.groups)), len(f.groups), _codes(pairs), times.astype(np.int32))], schema)

    return parts.repartition("rid", "no").mapInArrow(work, ddl)


def _compose_round(parts: DataFrame, fan: int, last: bool) -> DataFrame:
    """One fragment per ``fan`` adjacent ones (``sub`` is null), and the groups that close between them.

    In the last round each text has one fragment left, whose prefix is its first group.
    """
    ddl = f"rid long, no int, {_PART}, sub int, groups string, n_groups long, {_LISTS}"
    dealt = parts.withColumn("no", F.floor(F.col("no") / fan).cast("int")).repartition("rid", "no").sortWithinPartitions("rid", "no", "lo")

    def work(batches):
        schema, none = _arrow(ddl), [None] * 9
        rows: list[tuple] = []

        def closed(rid, lo, group):
            pairs, times = _links([group])
            rows.append((rid, None, lo, *none[1:], 0, group_text(group), 1, _codes(pairs), times.astype(np.int32)))

        def leave(now):
            (rid, no), lo, f, ok, na, nb = now
            if last and ok and (f.head[0] or f.head[1]):
                closed(rid, lo, f.head)
            rows.append((rid, no, lo, f.cut, *f.head, *f.tail, ok, na, nb, None, None, 0, [], []))

        now = None
        for b in batches:
            for r in b.to_pylist():
                f = Fragment(r["cut"], (r["head_a"], r["head_b"]), [], (r["tail_a"], r["tail_b"]))
                if now and now[0] == (r["rid"], r["no"]):
                    both = compose(now[2], f)
                    if both.groups:
                        closed(r["rid"], r["lo"], both.groups[0])
                    now = (now[0], now[1], Fragment(both.cut, both.head, [], both.tail), now[3] and r["ok"], now[4] + r["n_a"], now[5] + r["n_b"])
                else:
                    if now:
                        leave(now)
                    now = ((r["rid"], r["no"]), r["lo"], f, r["ok"], r["n_a"], r["n_b"])
            if rows:
                yield _batch(rows, schema)
                rows = []
        if now:
            leave(now)
            yield _batch(rows, schema)

    return dealt.mapInArrow(work, ddl)


def _long_texts(parts: DataFrame, paths: tuple[str, str], most: int) -> tuple[DataFrame, DataFrame]:
    """(rid, n_a, n_b, n_groups, groups_sha256) and (rid, pair, times) of the texts that were cut; ``most``: largest ``no``."""
    first = stage_table(_fragments(parts, paths))
    closed, now = [first.select("rid", "lo", "sub", "groups", "n_groups", "pairs", "times")], first
    while True:
        most //= FAN
        got = stage_table(_compose_round(now.select("rid", "no", *[c.split()[0] for c in _PART.split(", ")]), FAN, most == 0))
        closed.append(got.filter("sub IS NOT NULL").select(*closed[0].columns))
        now = got.filter("sub IS NULL")
        if most == 0:
            break
    good = now.filter("ok").select("rid", "n_a", "n_b")
    groups = closed[0]
    for c in closed[1:]:
        groups = groups.unionByName(c)
    groups = groups.filter("n_groups > 0").join(good.select("rid"), "rid", "left_semi")

    def digest(batches):
        now, sha, n = None, None, 0
        rows = []
        for b in batches:
            for rid, said, k in zip(*(b.column(c).to_pylist() for c in ("rid", "groups", "n_groups"))):
                if rid != now:
                    if now is not None:
                        rows.append((now, n, sha.hexdigest()))
                    now, sha, n = rid, hashlib.sha256(), 0
                sha.update(((";" if n else "") + said).encode())
                n += k
        if now is not None:
            rows.append((now, n, sha.hexdigest()))
        yield _batch(rows, _arrow("rid long, n_groups long, groups_sha256 string"))

    ordered = groups.select("rid", "lo", "sub", "groups", "n_groups").repartition("rid").sortWithinPartitions("rid", "lo", "sub")
    whole = good.join(ordered.mapInArrow(digest, "rid long, n_groups long, groups_sha256 string"), "rid")
    links = groups.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy("rid", F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("times"))
    return whole, links


def _document_counts(links: DataFrame) -> DataFrame:
    """(pair, n): how many rows of distinct ``pairs`` hold it; counted in each task before the shuffle."""

    def work(batches):
        held, size = [], 0

        def told():
            v, n = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return v, np.bincount(n, np.concatenate([k for _, k in held])).astype(np.int64)

        for b in batches:
            v, n = np.unique(b.column("pairs").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            held.append((v, n))
            size += len(v)
            if size > 4_000_000:
                v, n = told()
                held, size = [(v, n)], len(v)
                if size > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(n)], names=["pair", "n"])
                    held, size = [], 0
        if held:
            v, n = told()
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(n)], names=["pair", "n"])

    return links.select("pairs").mapInArrow(work, "pair int, n long")


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id", chunk: int = CHUNK, table: int = PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose joined token bytes of A or B differ from a space and the text, have no
    tokens: zeros and an empty string. A pair counts once per row that holds it linked, repeated rows and null keys
    included. An empty table gives an empty result. Other columns are ignored. A text without any cut is one chunk.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = stage_table(_aligned(rows, (path_a, path_b), chunk))
    short, parts = first.filter("no IS NULL"), first.filter("no IS NOT NULL")
    per_task = [_document_counts(short)]
    most = parts.agg(F.max("no").alias("m")).first()["m"]
    whole = cut = None
    if most is not None:
        whole, cut = _long_texts(parts, (path_a, path_b), most)
        cut = stage_table(cut)
        per_task.append(cut.groupBy("pair").agg(F.count("*").alias("n")))
    counts = per_task[0] if cut is None else per_task[0].unionByName(per_task[1])
    counts = counts.groupBy("pair").agg(F.sum("n").alias("n"))
    # an A id meets at most one row per id of B
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.shiftrightunsigned("pair", 16)))
    counts = stage_table(counts.select("pair", "n", best.alias("best")))
    out = ["doc_id", "n_a", "n_b", "n_groups", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"]
    sums = (F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    if counts.count() <= table:
        done = _looked_up(short, counts).select(*out)
    else:
        each = short.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        done = short.join(spread_join(each, counts, "pair", F.col("rid")).groupBy("rid").agg(*sums), "rid", "left").select(*out)
    if cut is None:
        return done
    met = spread_join(cut, counts, "pair", F.col("rid")).groupBy("rid").agg(*sums)
    heads = parts.filter("no = 0").select("rid", "doc_id")
    long = heads.join(whole, "rid", "left").join(met, "rid", "left").fillna(0, ["n_a", "n_b", "n_groups"]).fillna("", ["groups_sha256"])
    return done.unionByName(long.select(*out))


def _looked_up(short: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``short`` with n_links, n_best and count_sum from a broadcast table of pairs."""
    got = counts.toPandas().sort_values("pair")
    sent = short.sparkSession.sparkContext.broadcast((got["pair"].to_numpy(np.int32), got["n"].to_numpy(np.int64), got["best"].to_numpy(bool)))
    ddl = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    keep = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]

    def work(batches):
        pair, n, best = sent.value
        for b in batches:
            of, times = b.column("pairs"), b.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lens = of.value_lengths().to_numpy(zero_copy_only=False)
            at = np.searchsorted(pair, of.flatten().to_numpy(zero_copy_only=False))
            ends = np.cumsum(lens)
            sums = []
            for x in (times, times * best[at], times * n[at]) if len(at) else (times,) * 3:
                c = np.append(0, np.cumsum(x))
                sums.append(pa.array((c[ends] - c[ends - lens]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *sums], names=[c.split()[0] for c in ddl.split(", ")])

    return short.select(*keep, "pairs", "times").mapInArrow(work, ddl)
