"""The prefix trie of conversations against plain dictionaries."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from riskframe.llm import conversation_trie as ct

COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, path string, depth int, words long, kind string"


def _brute(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role is not None, role or ""), hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) + sum(saved[k] for k in kids[p])
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def _talks():
    x, rows = 7, []
    for c in [*range(0, 90), *range(200, 212), 2_000_000_001, -5, -20]:
        if c in (40, 60):
            continue  # no conversation to take the beginning from
        for t in range((c * 7) % 6 + (0 if c % 9 else 30)):
            x = (1103515245 * x + 12345) % 2**31
            rows.append((c, t, ["user", "assistant", None][(x >> 8) % 3 if t > 2 else t % 3], None if x % 17 == 0 else ["hi", "a b  c\td", "", "why\nnot", "é x"][(x >> 12) % (5 if t < 4 else 2)]))
    rows += [(c, t, "user", f"same start {t}") for c in range(1000, 1060) for t in range(3)]
    rows += [(1000 + c, None, "system", None) for c in range(60)] + [(500, 1, "user", "b"), (500, 1, "user", "a"), (500, 1, "user", "a"), (500, 0, None, "z")]
    rows += [(None, 0, "user", "nobody")] * 40
    return rows


@pytest.mark.parametrize("tasks, fan, piece, waiting", [(1, 32, 50_000, 20_000), (7, 32, 50_000, 20_000), (9, 2, 3, 2)])
def test_trie(spark, monkeypatch, tasks, fan, piece, waiting):
    for name, v in (("FAN", fan), ("PIECE", piece), ("WAITING", waiting)):
        monkeypatch.setattr(ct, name, v)
    rows = _talks()
    turns = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA).repartition(5)
    assert Counter(map(tuple, ct.trie(turns, tasks).select(*COLS).collect())) == _brute(rows)


def test_trie_of_nothing(spark):
    assert ct.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ct.trie(spark.createDataFrame([(None, 1, "user", "x", "", 1, 1, "")], SCHEMA)).count() == 0


def test_one_sequence_of_all(spark):
    rows = [(c, 0, "user", "the same words") for c in range(20, 400)]
    out = ct.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 8).select(*COLS).collect()
    assert Counter(map(tuple, out)) == _brute(rows)


def test_common_turns():
    a, b = bytes(range(48)), bytes(range(48))
    assert ct.common_turns(a, b) == 3 and ct.common_turns(a, b[:32]) == 2 and ct.common_turns(a, b"\xff" * 48) == 0 and ct.common_turns(b"", a) == 0
    assert ct.common_turns(a, a[:40] + b"\xff" * 8) == 2


def test_of_the_table(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    out = ct.trie(turns).select(*COLS).collect()
    assert Counter(map(tuple, out)) == _brute([tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])
