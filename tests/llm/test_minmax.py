"""Min-max hashing against all pairs in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose

from riskframe.llm import minmax_hash as mh
from riskframe.llm import near_links as nl
from riskframe.llm.words import shingles


def _set(text, k=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def _brute(rows, k=2):
    sets = [_set(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                up[top(i)] = top(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[top(i)] = min(low.get(top(i), r[0]), r[0])
    return Counter((r[0], len(s), low.get(top(i), r[0]), r[0] == low.get(top(i), r[0])) for i, (r, s) in enumerate(zip(rows, sets)))


def _copies():
    x = np.random.default_rng(11)
    rows = []
    for g in range(12):
        base = prose(g * 7 + 1, 60 + 25 * g).split()
        for _ in range(7):
            words = list(base)
            for _ in range(int(x.integers(0, 10))):
                words[int(x.integers(0, len(words)))] = f"w{int(x.integers(0, 999))}"
            rows.append(" ".join(words))
    rows += rows[:5] + ["one", "one", "ONE ", "one two", "a b c d e f", "a b c d e f g", "a b c d e", prose(900, 2500), prose(900, 2500) + " tail"]
    # a chain: neighbours are similar, the ends are not
    chain = prose(77, 100).split()
    for i in range(12):
        rows.append(" ".join(chain))
        chain[8 * i] = f"new{i}"
    return list(enumerate(rows)) + [(None, rows[3]), (None, rows[3]), (None, "alone without id"), (4, rows[30]), (4, "nothing like it at all")]


@pytest.mark.parametrize("block, part", [(512, 256), (3, 2)])
def test_near_duplicates(spark, monkeypatch, block, part):
    monkeypatch.setattr(nl, "BLOCK", block)
    monkeypatch.setattr(nl, "PART", part)
    monkeypatch.setattr(nl, "HOT", 5)
    rows = _copies()
    out = mh.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert Counter(map(tuple, out.select("doc_id", "n_shingles", "component_id", "kept").collect())) == _brute(rows)


def test_edges(spark, edge, edge_rows, empty):
    assert Counter(map(tuple, mh.near_duplicates(edge).collect())) == _brute([r[:2] for r in edge_rows])
    assert mh.near_duplicates(empty).count() == 0


def test_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert Counter(map(tuple, mh.near_duplicates(docs).collect())) == _brute([tuple(r) for r in docs.collect()])


def test_signatures_estimate_similarity():
    """Both ends match with the similarity, and their mean has less spread than as many minima alone would have."""
    x = np.random.default_rng(2)
    err = []
    for t in range(60):
        pool = x.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = np.unique(pool[:360]), np.unique(pool[40:])  # 320 of 400
        s = mh.signatures(np.append(a, b), np.array([0, len(a), len(a) + len(b)]))
        err.append((s[0] == s[1]).mean() - 0.8)
    assert abs(np.mean(err)) < 0.01 and np.std(err) < 1.15 * np.sqrt(0.8 * 0.2 / (2 * mh.HASHES))


def test_bands_hold_one_end_each():
    s = np.arange(2 * mh.HASHES, dtype=np.uint32).reshape(1, 2, mh.HASHES)
    one = mh.bands(s)
    changed = s.copy()
    changed[0, 1] += 1  # all maxima
    same = (mh.bands(changed) == one)[0]
    assert same[: len(same) // 2].all() and not same[len(same) // 2 :].any() and len(set(one[0].tolist())) == one.shape[1]


def test_bound_is_never_below_the_overlap():
    texts = [r[1] for r in _copies() if r[1]]
    value, bounds = shingles(texts, 2)
    sets = [value[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
    got = nl.most_shared([nl.unpacked(nl.sketch(s)) for s in sets], [nl.unpacked(nl.sketch(s, 16, 64)) for s in sets])
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert (got >= want).all() and (np.diag(got) == np.diag(want)).all()
