"""Content sort, shards, mixing and personal data against plain Python."""

import hashlib
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import content_sort as cs
from riskframe.llm.balanced_shards import assign, balanced_shards, cut_edges
from riskframe.llm.pfair_mixing import deal, mix, mixed_rows, quotas, schedule
from riskframe.llm.pii_spans import luhn, mod97, pii, pii_digest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("spread", [True, False])
def test_content_sort(edge, edge_rows, spread, monkeypatch):
    if not spread:
        monkeypatch.setattr(cs, "_common", lambda rows, n, parts: rows.sparkSession.createDataFrame([], "hot string, salts int"))
    groups = defaultdict(list)
    for r in edge_rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = cs.content_sort(edge).collect()
    assert len(out) == len(edge_rows)
    kept = Counter()
    for norm, ids in groups.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        rows = [r for r in out if r.text_sha256 == sha]
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, ids))
        keep = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in rows} == {(keep, len(ids))}
        assert [r.doc_id for r in rows if r.kept] == [keep]
        kept[sha] += 1
    left = cs.keep_first_copies(edge)
    assert left.columns == edge.columns and left.count() == len(groups)


def test_hot_text_is_spread(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'hot text' ELSE concat('cold ', id) END AS text")
    assert cs._common(rows.selectExpr("doc_id AS id", "text AS norm"), 4000, 8).first().salts >= 8
    out = cs.content_sort(rows).filter("text_sha256 = sha2('hot text', 256)")
    assert out.select("keep_id", "group_size").distinct().collect() == [(3998, 2000)]
    assert out.filter("kept").count() == 1


def test_shards(edge, edge_rows):
    out = balanced_shards(edge).collect()
    assert len(out) == len(edge_rows)
    counts = Counter(r.shard for r in out)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts.get(s, 0) for s in range(16)) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert {(r.law, r.grown_shard) for r in out} == {("rows", None)}


def test_shards_cut_fewer_edges(spark):
    rows = spark.range(1600).selectExpr("id AS doc_id", "concat('text ', CASE WHEN id < 1000 THEN id % 250 ELSE id END) AS text")
    before = cut_edges(assign(rows, rounds=0)).first()
    after = cut_edges(assign(rows)).first()
    assert before.edges == after.edges == 250 * 6
    assert after.cut < 0.25 * before.cut


def test_schedule_lag(spark):
    table = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 1.0), ("d", 0.4), ("e", 0.01)], "source string, weight double")
    quota = quotas(table, 100)
    q = {r.source: r.quota for r in quota.collect()}
    assert sum(q.values()) == 100 and min(q.values()) >= 1
    rows = sorted(schedule(quota).collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(100))
    served = Counter()
    for r in rows:
        assert r.j == served[r.source]
        served[r.source] += 1
        assert all(abs(served[s] - q[s] * (r.slot + 1) / 100) < 1 for s in q)
    assert dict(served) == q


def test_mix(edge, edge_rows, spark):
    out = sorted(mix(edge, block_rows=2).collect(), key=lambda r: r.position)
    assert [r.position for r in out] == list(range(len(edge_rows)))
    assert Counter((r.doc_id, r.source) for r in out) == Counter((r[0], r[3]) for r in edge_rows)
    places = defaultdict(set)
    for r in out:
        places[r.slot].add((r.source, r.block))
    assert all(len(v) == 1 for v in places.values())  # one block a slot
    weights = spark.createDataFrame([("hot", 1.0), ("s1", 3.0), (None, 0.0)], "source string, weight double")
    given = sorted(mix(edge, weights, block_rows=1).collect(), key=lambda r: r.position)
    first = [r.source for r in given[:12]]
    assert Counter(first) == {"s1": 9, "hot": 3}  # the target proportions, before other sources
    assert len(given) == len(edge_rows)


def _lag(order, weights, blocks):
    """The greatest distance of a source from its share, up to the slot in which the first source runs out."""
    share, had, worst = np.array(weights) / sum(weights), np.zeros(len(weights)), 0.0
    for t, i in enumerate(order, 1):
        had[i] += 1
        worst = max(worst, np.abs(had - share * t).max())
        if had[i] == blocks[i]:
            return t, worst


@pytest.mark.parametrize("weights", [[0.9] + [0.1 / 249] * 249, [500.0] + [1.0] * 500, [float(i**3) for i in range(1, 21)], [n**0.7 for n in (3, 50, 700, 7000)], [1 / 3, 1e-7, 0.5]])
def test_every_slot_follows_the_weights(weights):
    blocks = [max(1, int(30_000 * w / sum(weights))) for w in weights]
    order = deal(weights, blocks)
    assert Counter(order.tolist()) == {i: n for i, n in enumerate(blocks)}
    slots, worst = _lag(order, weights, blocks)
    assert slots > 1000 and worst < 1


def test_mix_follows_the_weights_of_many_sources(spark):
    rows = [(i, f"text {i}", "big" if i < 1800 else f"s{i % 100}") for i in range(2800)]
    weights = {"big": 900.0, **{f"s{i}": 1.0 for i in range(100)}}
    table = spark.createDataFrame(list(weights.items()), "source string, weight double")
    out = sorted(mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), table, block_rows=2).collect(), key=lambda r: r.position)
    assert [r.slot for r in out] == [i // 2 for i in range(2800)]
    names = list(weights)
    order = [names.index(r.source) for r in out[::2]]
    slots, worst = _lag(order, list(weights.values()), [900] + [5] * 100)
    assert slots > 900 and worst < 1


def test_mixed_rows_keep_everything(edge, edge_rows):
    out = mixed_rows(edge)
    assert out.columns == edge.columns
    assert Counter(map(tuple, out.collect())) == Counter(edge_rows)


def _plain(text):
    found = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if good(k, m[0])] for k, p in found.items()}


TEXTS = [
    "mail a.b@c.de, x@y (no) é😀 jo_e%+-@sub.host-1.org. a@b.cd_x@e.fg a@b@c.de ..@a.b.c. q@r.st.uv-",
    "ips 1.2.3.4 256.1.1.1 1.2.3.4.5 0001.2.3.255 1.2.3 10.0.0.1.2.3.4.5 99999999999999999999.1.1.1 1.1.1.1.",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111111111111111 5 5500 0000 0000 0004 12  34 0000000000000 378282246310005",
    "call +1 (555) 123-4567 or +49.30.1234567 +12 +1234567890123456 +4 +1+44 20 7946 0958 tel 555-123-4567",
    "IBAN DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00, GB82WEST12345698765432",
    "1 " * 5000 + "a" * 3000 + "@" + "b" * 3000, "", None, "@", "+", "9" * 3000, "1." * 2000, "a@" * 3000 + "b.c",
]


def test_pii_spans(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii_digest(rows).collect()}
    for i, t in enumerate(TEXTS):
        want = _plain(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, v in want.items() for s, e in v)
        r = out[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want.values()], t[:60]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
    assert out[4].n_added == 2 and out[4].spans.count("iban:") == 2  # the wrong checksum is left out
    assert "localphone:" in out[3].spans
    scored = pii(rows).filter("doc_id = 4").first().scored
    assert all(x.score >= 0.6 and x.kind == "iban" for x in scored)


def test_pii_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: _plain(r.text or "") for r in docs.collect()}
    for r in pii_digest(docs).collect():
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in want[r.doc_id].values()]


def test_pii_many_matches_in_one_text(spark):
    """Offsets over many blocks, overlaps by halving, contexts across neighbouring matches; linear in the matches."""
    many = "10;" * 200_000
    mixed = "call 555-123-4567 call (555) 123-4567 a@b.com +1 202 555 0143 1.2.3.4 " * 1500 + 'token = "0123456789abcdef0123456789abcdef01234567" ' * 40
    rows = spark.createDataFrame([(1, many), (2, mixed), (3, "token " + "a" * 40), (4, "sha 0123456789abcdef0123456789abcdef01234567")], "doc_id long, text string")
    begin = time.time()
    out = {r.doc_id: r for r in pii_digest(rows).collect()}
    assert time.time() - begin < 60
    for i, t in ((1, many), (2, mixed)):
        want = _plain(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, v in want.items() for s, e in v)
        assert [out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone] == [len(v) for v in want.values()]
        assert out[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and out[i].spans.startswith(joined)
    base = sorted(p for v in _plain(mixed).values() for p in v)
    added = [tuple(map(int, x.split(":")[1:])) for x in out[2].spans.split(",") if x.split(":")[0] in ("localphone", "secret")]
    assert len(added) == out[2].n_added and out[2].spans.count("secret:") == 40 and out[2].spans.count("localphone:") >= 1500
    taken = {c for s, e in base for c in range(s, e)}
    assert not any(c in taken for s, e in added for c in range(s, e))
    assert out[3].n_added == 0 and out[4].n_added == 0  # one letter only; no context word


def test_pii_edges(edge, edge_rows):
    assert pii_digest(edge).count() == len(edge_rows)


def test_checksums(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(luhn(F.lit("79927398713")).alias("a"), luhn(F.lit("79927398710")).alias("b"), mod97(F.lit("GB82WEST12345698765432")).alias("c"), mod97(F.lit("GB83WEST12345698765432")).alias("d")).first()
    assert tuple(r) == (True, False, True, False)


def test_empty_tables(empty):
    for f in (cs.content_sort, balanced_shards, mix, pii_digest, cs.keep_first_copies, mixed_rows):
        assert f(empty).count() == 0
