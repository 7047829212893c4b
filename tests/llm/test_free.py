"""URL templates, classifiers, packing, fingerprints, near copies and the pipeline against plain Python."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import prose
from pyspark.sql import functions as F

from riskframe.llm import order_minhash as om
from riskframe.llm import prefix_tree_join as pt
from riskframe.llm import quality_qda as qda
from riskframe.llm import toxicity_automata as tox
from riskframe.llm import url_templates as ut
from riskframe.llm.bpe import PieceEncoder
from riskframe.llm import near_links as nl
from riskframe.llm.mixture_packing import LENGTH, Service, pack
from riskframe.llm.pfair_mixing import mix
from riskframe.operators.components import components

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))

# ---------------------------------------------------------------- URL templates

URLS = ["http://A.Example.com/en/x", "https://www.example.com/en/1?a=/b", "http://x.net/es/1", "http://x.net/es", "http://fr.x.net/fr/", "no scheme/en/", None, "", "http://", "http://h?x/y", "a://b://c/d", "//x://Y.ORG#f", "http://example.com/english", "http://badexample.com/en/", "http://netnet/es/", "http://com/x", "HTTP://ÀB.com/É/1"]


def _rule(host, path):
    best = None
    for text, said in ut.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, said)
    return best


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.net/es/1")], "page_id long, url string")
    out = {r.page_id: r for r in ut.judge(pages, spark.createDataFrame([], "page_id long, y int")).collect()}
    assert len(out) == len(URLS) + 1
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        want = _rule(host, path)
        assert (out[i].host, out[i].path) == (host, path)
        assert (out[i].rule, out[i].verdict) == (want or (None, "allow"))


def test_url_templates_reject_by_purity(spark):
    rows = [(i, f"http://mixed.org/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(200)] + [(1000 + i, f"http://other.org/a/{i}") for i in range(40)]
    marks = [(i, i % 2) for i in range(0, 100)] + [(1000 + i, 0) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = ut.judge(pages, spark.createDataFrame(marks, "page_id long, y int")).collect()
    assert {r.template for r in out if r.host == "mixed.org"} == {"/spam/*N.W", "/news/*N.W"}
    assert all((r.verdict == "block") == ("/spam/" in r.path) for r in out)


def test_siblings_are_merged(spark):
    rows = [("h", f"/{a}/*N", y) for a in ("p", "q", "r") for y in (1, 1)] + [("h", "/clean/*N", 0)] * 30
    got = {r.template: r for r in ut.judged_templates(spark.createDataFrame(rows, "host string, template string, y int")).collect()}
    assert got["/p/*N"].n == 6 and got["/p/*N"].rejected  # two labels alone would be too few
    assert not got["/clean/*N"].rejected


def test_urls_edges(spark):
    assert ut.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, y int")).count() == 0
    same = spark.createDataFrame([(1, "http://a.org/x", 5)] * 3, "page_id long, url string, n int")
    assert ut.judge(same, spark.createDataFrame([(1, 1)], "page_id long, y int")).count() == 3


def _verdicts(spark, urls, marks):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = ut.judge(pages, spark.createDataFrame(marks, "page_id long, y int")).collect()
    return {r.page_id: (r.verdict, r.template) for r in out}


def _templates(paths):
    """Level by level over whole trees, every path to its last segment."""
    at = {p: ("", p.removeprefix("/").split("/")) for p in paths}
    for d in range(max(len(segs) for _, segs in at.values())):
        places = defaultdict(list)
        for p, (t, segs) in at.items():
            if d < len(segs):
                places[t].append((segs[d], paths[p], p))
        for t, held in places.items():
            rows, by = sum(n for _, n, _ in held), Counter()
            for seg, n, _ in held:
                by[seg] += n
            varies = len(by) >= ut.VARIED and len(by) >= ut.SPREAD * len(held)
            for seg, _, p in held:
                turned = varies and by[seg] < ut.LITERAL * rows
                kind = "*" + re.sub(r"[^\W\d_N]+|(?<![*])N(?=[a-z])", "W", re.sub(r"[0-9]+", "N", seg), flags=re.ASCII)
                at[p] = (t + "/" + (kind if turned else seg), at[p][1])
    return {p: t for p, (t, _) in at.items()}


def _tree_paths():
    paths = {f"/a/{i % 9}/x{i % 31}/{'new' if i % 2 else 'old'}/{i}.html": 1 + i % 3 for i in range(150)}
    paths |= {f"/same/{'s/' * 40}{i % 12}/t/u/{i}": 1 for i in range(40)} | {f"/few/{i}/{'y/' * 5}z": 2 for i in range(7)}
    paths |= {"/": 3, "": 1, "//": 1, "/a": 5, "/a/": 1, "/same": 1, "/same/" + "s/" * 40: 2, "/same/" + "s/" * 41: 1} | {"/hot/page": 1000}
    return paths | {f"/hot/{'pqrstuvwxyz'[i % 11]}{i}/1": 1 for i in range(30)} | {"/c" * i: 1 for i in range(1, 12)}


def test_templates_like_brute_force(spark):
    paths = _tree_paths()
    rows = [(h, p, n) for h in ("one.org", "two.org") for p, n in paths.items()]
    got = ut.templates(spark.createDataFrame(rows, "host string, path string, n long")).collect()
    want = _templates(paths)
    assert len(got) == len(rows) and {(r.host, r.path): r.template for r in got} == {(h, p): want[p] for h, p, _ in rows}


def test_a_very_deep_path_takes_few_rounds(spark):
    deep = "/q" * 2000
    paths = {f"/w/{i}": 1 for i in range(60)} | {deep: 1, deep + "/r": 1} | {f"/v{'/v' * 500}/{i}": 1 for i in range(20)}
    begin = time.monotonic()
    got = {r.path: r.template for r in ut.templates(spark.createDataFrame([("h", p, n) for p, n in paths.items()], "host string, path string, n long")).collect()}
    assert time.monotonic() - begin < 60
    assert got[deep] == deep and got["/w/7"] == "/w/*N" and got[f"/v{'/v' * 500}/3"] == f"/v{'/v' * 500}/3"


def test_small_places_are_judged(spark):
    urls = [f"http://few.org/{a}/{i}" for a in ("aa", "bb") for i in range(5)] + ["http://few.org/aa/x/y/1", "http://few.org/cc", "http://free.org/aa/1"]
    got = _verdicts(spark, urls, [(i, 1) for i in range(4)] + [(i, 0) for i in range(5, 9)])
    assert got[4][0] == "block"  # an unlabelled sibling of bad pages
    assert got[9][0] == "allow"  # and of good ones
    assert got[10][0] == "block"  # no sibling, but a place below the bad node
    assert got[12][0] == "allow"  # nothing known of the host


def test_repeated_paths_vary_by_distinct_paths(spark):
    urls = [f"http://often.org/a/{i % 40}" for i in range(1600)]
    assert {t for _, t in _verdicts(spark, urls, [(0, 1)]).values()} == {"/a/*N"}


def test_deep_paths_stay_apart(spark):
    urls = [f"http://deep.org/a/b/c/d/e/{'spam' if i % 2 else 'news'}/{i}" for i in range(60)]
    got = _verdicts(spark, urls, [(i, i % 2) for i in range(30)])
    assert {t for _, t in got.values()} == {"/a/b/c/d/e/spam/*N", "/a/b/c/d/e/news/*N"}
    assert all((v == "block") == (i % 2 == 1) for i, (v, _) in got.items())


# ---------------------------------------------------------------- classifiers


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


# in these tables about one text in twenty of those labelled toxic holds no toxic word, so no score ranks it high
@pytest.mark.parametrize("op, label, folds, fold, least", [(qda.quality, "quality", 4, 2, 0.99), (tox.toxicity, "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, op, label, folds, fold, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = op(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % folds == fold for i in out["doc_id"]]).all()
    test = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert len(test) > 300
    assert _auc(test["score"].to_numpy(), test[label].to_numpy()) > least
    assert (test["predicted"] == test[label]).mean() > 0.97


@pytest.mark.parametrize("op", [qda.quality, tox.toxicity])
def test_classifier_edges(spark, edge, edge_rows, empty, op):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (5, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = op(edge, labels).collect()
    assert len(out) == len(edge_rows) and all(0 <= r.score <= 1 for r in out)
    by_text = defaultdict(set)
    texts = {r[0]: r[1] for r in edge_rows}
    for r in out:
        by_text[texts[r.doc_id] or ""].add(round(r.score, 9))
    assert all(len(v) == 1 for k, v in by_text.items() if k not in ("no id",))
    assert op(empty, labels).count() == 0
    assert op(edge, labels.limit(0)).count() == len(edge_rows)


@pytest.mark.parametrize("marks", [[(i, 1) for i in range(60)], [(9999, 0), (9998, 1)]])
def test_everything_is_kept_without_a_classifier(spark, edge, edge_rows, marks):
    out = qda.keep_good(edge, spark.createDataFrame(marks, "doc_id long, quality int"))
    assert out.columns == edge.columns and Counter(map(tuple, out.collect())) == Counter(edge_rows)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", None, "One two two two.", "É!! ÀÉ ab", prose(3, 500), "a|b | c\n!!!! AAA"]
    alone = np.concatenate([qda.statistics([t]) for t in texts])
    assert np.allclose(alone, qda.statistics(texts)) and np.isfinite(alone).all()


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    terms = ["loser", "idiot", "moron", "disgusting", "worthless", "ab", "scum", "scums"]
    finder = tox.Finder(terms)
    alphabet, x = "abdeginorstuw", 7
    words = {"losr", "lloser", "1diot", "idio", "disgstng", "worthles", "wortless", "ab", "abc", "sum", "scum", "scumsy", "", "l", "los"}
    for t in terms:
        for k in range(60):
            x = (1103515245 * x + 12345) % 2**31
            i, c = x % (len(t) + 1), alphabet[(x >> 8) % len(alphabet)]
            w = [t[:i] + c + t[i:], t[:i] + c + t[i + 1 :], t[:i] + t[i + 1 :]][(x >> 16) % 3]
            words |= {w, w[::-1], w[:i] + alphabet[(x >> 4) % len(alphabet)] + w[i:]}
    for w in words:
        near = sorted((_distance(t, w), t) for t in terms if _distance(t, w) <= tox.allowed(t))
        want = (near[0][1], near[0][0]) if near else None
        assert tox.nearest(finder.root, w) == want and sorted(finder.in_reach(w)) == near, w


def test_quality_steps():
    texts = [None, "", "a" * qda.STEP, "b" * 3 * qda.STEP, "c"] + ["d"] * 1200
    steps = list(qda._steps(texts))
    assert [t for s in steps for t in s] == texts and not list(qda._steps([]))
    assert all(len(s) == 1 or (len(s) <= qda.ROWS and sum(len(t or "") for t in s) <= qda.STEP) for s in steps)


def test_misses_go_to_the_next_term():
    f = tox.Finder(["moron", "morons"], exact_only={"moron"})
    assert f.look("morond") == 1 and f.look("moran") is None and f.look("moron") == 0
    assert tox.Finder(["idiot"], spared={"idiom"}).look("idiom") is None and tox.Finder(["idiot"], spared={"idiom"}).look("idiott") == 1


def test_forgiving_goes_by_rates():
    n = {0: 10_000, 1: 1_000}
    wrong, spared = tox.forgiving([("idiom", 0, 1), ("looser", 30, 1), ("scam", 2, 400), ("scun", 9, 1)], ["idiot", "loser", "scum"], n)
    assert spared == {"idiom", "scam"}  # a single clean text spares the word, not the term
    assert wrong == {"scum"}


def test_lexicon_counts_a_word_and_its_beginnings_once():
    toxic = [{"pathetic", "pathet*", "pathe*", "path*"} | ({"moron", "idiot"} if i < 6 else set()) for i in range(40)]
    assert {"pathetic", "moron", "idiot"} <= set(tox.lexicon(toxic))  # three words, not three beginnings of one
    assert tox.lexicon([{f"aa{k}bc" for k in range(6)}] * 5) == ["aa3bc", "aa4bc", "aa5bc"]
    # a beginning that stands for two words brings both
    assert {"idiots", "idiotic"} <= set(tox.lexicon([{"idiot*", "idiots"}] * 4 + [{"idiot*", "idiotic"}] * 4))
    assert tox.kin("path*", "pathet*") and tox.kin("pathetic", "path*") and not tox.kin("idiots", "idiotic") and not tox.kin("idiot", "idiots")


def test_beginnings():
    f = tox.Finder(["vequ*", "lostran*", "idiot"])
    assert f.look("vequaire") == 0 and f.look("vequ") == 0 and f.look("vegu") is None
    assert f.look("lostranei") == 0 and f.look("lustranei") == 1 and f.look("idi0t") == 1 and f.look("lostr") is None


def test_context_of_a_hit():
    f = tox.Finder(["moron", "disgusting"])
    plain, quoted, addressed = f.features("that moron ran away"), f.features('he read "moron" aloud'), f.features("you are a m0ron and dusgustin")
    assert plain[0] > 0 and quoted[1] > 0 and quoted[0] == 0
    assert addressed[2] > plain[2] == 0 and addressed[3] > 0
    assert f.features(None) == f.features("") == [0.0] * 5


# ---------------------------------------------------------------- packing


def test_piece_encoder_equals_the_tokenizer():
    enc = PieceEncoder(PATH)
    texts = ["", None, " ", "a  b   c\n \n d \t e", "x <|endoftext|> y<|endoftext|>z  <|endoftext|>", "  a   b \n\n c", "it's I'll  we've 's ", "\x1c \x1cb, c.", "é" * 500 + "  \n ", "w." * 40 + " x), y,", prose(1, 3000)]
    x = 3
    for _ in range(400):
        out = []
        for _ in range(50):
            x = (1103515245 * x + 12345) % 2**31
            out.append(" ab\n\té 's1.<,"[(x >> 16) % 13])
        texts.append("".join(out))
    for _ in range(2):
        got = enc.encode_batch(texts)
        for t, g in zip(texts, got):
            assert enc.ids(g).tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("weights", [None, [3, 1, 0, 2, 1]])
@pytest.mark.parametrize("big", [False, True])
def test_service(weights, big):
    totals = [50_000, 333, 7, 12_345, 1]
    s = Service(totals, weights)
    if big:
        s.kind = object
    n = np.arange(0, s.total + 1, 13)
    own = [s.served(i, n)[0] for i in range(5)]
    before = [s.served(i, n)[1] for i in range(5)]
    assert (sum(own) == n).all() and all((np.diff(o.astype(int)) >= 0).all() for o in own)
    assert all((before[i + 1] == before[i] + own[i]).all() for i in range(4))
    assert [int(s.served(i, np.array([s.total]))[0][0]) for i in range(5)] == totals
    if weights is None:  # every queue is near its share all the time
        assert all(np.abs(o.astype(float) - n * t / s.total).max() < 3 for o, t in zip(own, totals))


def _check_packed(out, rows):
    tok = PieceEncoder(PATH).tokenizer
    docs = defaultdict(list)
    for d, t in rows:
        docs[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for d, lists in docs.items():
        assert sum(p.length for p in pieces[d]) == sum(map(len, lists))
        if len(lists) == 1:
            ids, at = lists[0], 0
            for p in sorted(pieces[d], key=lambda p: p.start):
                assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
                assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
                at += p.length
    for w, spans in windows.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == LENGTH or (at < LENGTH and w == max(windows))
    assert sorted(windows) == list(range(len(windows)))


@pytest.mark.parametrize("weights", [None, {"s0": 2.0, "s1": 1.0, None: 1.0}])
def test_pack_edges(edge, edge_rows, empty, weights):
    _check_packed(pack(edge, PATH, weights).collect(), [r[:2] for r in edge_rows])
    assert pack(empty, PATH, weights).count() == 0


def test_pack_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = pack(docs, PATH).collect()
    _check_packed(out, [(r.doc_id, r.text) for r in docs.collect()])
    total = Counter()
    for r in out:
        total[r.queue] += r.length
    whole = sum(total.values())
    for w in range(whole // LENGTH):
        took = Counter()
        for r in out:
            if r.sequence_id == w:
                took[r.queue] += r.length
        assert all(abs(took[q] - LENGTH * total[q] / whole) < 12 for q in total)
        if w == 20:
            break


def test_many_sources_share_queues(spark, monkeypatch):
    from riskframe.llm import mixture_packing as mp

    monkeypatch.setattr(mp, "QUEUES", 8)
    rows = spark.range(50).selectExpr("id AS doc_id", "concat('some text ', id) AS text", "concat('source', id) AS source")
    _check_packed(pack(rows, PATH).collect(), [(r.doc_id, r.text) for r in rows.collect()])


def _took(out, windows):
    took = [Counter() for _ in range(windows)]
    for r in out:
        if r.sequence_id < windows:
            took[r.sequence_id][r.queue] += r.length
    return took


@pytest.mark.parametrize("weights", [[3, 1, 0, 2, 1], [1e-9, 3e-9, 0, 0, 0], [0] * 5, [0.5, 0.1, 7, 0.001, 40]])
def test_service_follows_the_weights(weights):
    totals = [5_000, 333, 70, 1_234, 1]
    s = Service(totals, weights)
    own = np.array([s.served(i, np.arange(s.total + 1))[0] for i in range(5)], float)
    assert (np.diff(own) >= 0).all() and (own.sum(axis=0) == np.arange(s.total + 1)).all()
    for group in ([w > 0 for w in weights], [not w for w in weights]):
        held = [i for i in range(5) if group[i]]
        pace = weights if any(group) and weights[held[0]] else totals
        for t in np.linspace(0, max((totals[i] / pace[i] for i in held), default=0), 2000):
            fluid = {i: min(totals[i], pace[i] * t) for i in held}
            n = int(sum(fluid.values())) + (0 if pace is weights else sum(t for t, w in zip(totals, weights) if w))
            assert all(abs(own[i, n] - fluid[i]) < 4 for i in held)


def test_weights_of_more_sources_than_queues(spark, monkeypatch):
    from riskframe.llm import mixture_packing as mp

    monkeypatch.setattr(mp, "QUEUES", 8)
    rows = [(i, prose(i, 300), f"s{i % 40}" if i % 41 else None) for i in range(900)] + [(1000 + i, prose(i, 300), "hot") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {**{f"s{i}": 1.0 + i % 3 for i in range(40)}, "hot": 40.0, None: 2.0}
    out = pack(docs, PATH, weights).collect()
    _check_packed(out, [r[:2] for r in rows])
    assert {r.queue for r in out} == set(weights)
    for took in _took(out, 10):
        assert all(abs(took[q] - LENGTH * w / sum(weights.values())) < 12 for q, w in weights.items())


def test_pack_does_not_depend_on_partitions(edge):
    rows = edge.dropDuplicates(["doc_id", "text"])
    a, b = (pack(rows.repartition(n, c), PATH, length=64).collect() for n, c in ((3, "text"), (7, "doc_id")))
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


# ---------------------------------------------------------------- fingerprints


def _kmers(text):
    words = [w for w in re.split(r"[\x09-\x0D\x20]+", text) if w]
    seen, out = Counter(), []
    for i in range(len(words)):
        k = tuple(words[i : i + 2])
        seen[k] += 1
        out.append((k, seen[k]))
    return out


def test_fingerprints(spark, edge, edge_rows, empty):
    rows = [(i, t) for i, t in enumerate([prose(1, 300), prose(2, 300), prose(1, 300), None, "", "one", "a b a b a b " * 60, "ü" * 7, prose(4, 40)])]
    out = {r.doc_id: r for r in om.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out[d].n_chars == len(t) and out[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[d].near_edited <= 1 and 0 <= out[d].near_next <= 1
        if edited == t:
            assert out[d].near_edited == 1 and out[d].fingerprint == out[d].edited_fingerprint
    assert out[0].fingerprint == out[2].fingerprint != out[1].fingerprint
    assert out[0].near_edited > 0.2 > out[0].near_next
    got = om.fingerprints(edge).collect()
    assert len(got) == len(edge_rows)
    by = defaultdict(set)
    texts = defaultdict(set)
    for r in edge_rows:
        texts[r[0]].add(r[1] or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            by[next(iter(texts[r.doc_id]))].add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    assert om.fingerprints(empty).count() == 0
    one = om.fingerprints(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_whole_documents_edited(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    out = {r.doc_id: r for r in om.fingerprints(docs).collect()}
    for i, (d, t) in enumerate(rows):
        half, nxt = len(t) // 2, rows[(i + 1) % len(rows)][1]
        assert out[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()


def test_order_and_repeats_matter(spark):
    a = prose(9, 200).split()
    turned = a[100:] + a[:100]
    texts = [" ".join(a), " ".join(a), " ".join(turned), " ".join(a[:50] * 4), " ".join(a[:50] * 3 + a[50:100])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    fp = {r.i: r.fp for r in om.with_fingerprint(df, "text", "fp").collect()}
    assert fp[0] == fp[1] and fp[2] != fp[0] and fp[3] != fp[4]
    # the same k-mers but one at the seam: entries differ because the order of the picked ones does
    assert 0 < sum(x == y for x, y in zip(fp[0], fp[2])) < om.BINS
    # against a plain build of one text: the picked k-mers of each bin are the same number
    assert sum(x is not None for x in fp[0]) <= min(om.BINS, len(_kmers(texts[0])))


# ---------------------------------------------------------------- near copies


def _brute(rows):
    sets = []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)):
                k = len(a & b)
                if 100 * k >= 80 * (len(a) + len(b) - k):
                    parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return Counter((d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def _edited(words, seed, n):
    out, x = list(words), seed + 1
    for _ in range(n):
        x = (1103515245 * x + 12345) % 2**31
        out[(x >> 8) % len(out)] = f"edit{x % 9999}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    rows = []
    for g in range(12):
        base = prose(100 + g, 60 + 25 * g).split()
        rows += [(1000 * g + i, _edited(base, 31 * g + i, i % 6)) for i in range(14)]
    rows += [(50_000 + i, prose(900 + i, 20 + i)) for i in range(60)]
    shared = prose(777, 60)
    rows += [(60_000 + i, shared + " " + prose(2000 + i, 40)) for i in range(40)]  # a passage in common, not copies
    return rows


@pytest.mark.parametrize("common, part, block", [(3, 256, 512), (10**9, 3, 4), (1, 2, 2)])
def test_near_duplicates(spark, copies, common, part, block, monkeypatch):
    monkeypatch.setattr(pt, "COMMON", common)
    monkeypatch.setattr(nl, "BLOCK", block)
    monkeypatch.setattr(nl, "PART", part)
    out = pt.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string").repartition(6))
    assert Counter(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect())) == _brute(copies)


def test_common_shingles_are_counted_over_all_texts(spark, monkeypatch):
    """12 of 24,000 texts hold one passage: 4 of every 8,000, however the rows are dealt."""
    passage = "five words that come back"
    own = F.concat_ws(" ", *[F.concat(F.lit(w), "id") for w in "vwxyz"])
    padded = F.concat(F.lit(passage), F.expr("repeat(' ', cast(id / 2000 as int))"))
    docs = spark.range(24_000).select(F.when(F.col("id") % 2000 == 7, padded).otherwise(own).alias("text"))
    one, two = (int(at[0]) for at in pt._counters(pt.shingles([passage], pt.SHINGLE)[0]))
    for parts, flush in ((3, pt.FLUSH), (7, 500)):
        monkeypatch.setattr(pt, "FLUSH", flush)
        level = pt._common(docs.repartition(parts), 24_000)
        assert level[0, one] == level[1, two] == 1 + 8 * 2
        assert 0 < np.count_nonzero(level[0]) < 10


def test_near_duplicate_edges(spark, edge, edge_rows, empty):
    want = _brute([r[:2] for r in edge_rows])
    assert Counter(map(tuple, pt.near_duplicates(edge).collect())) == want
    assert pt.near_duplicates(empty).count() == 0
    left = pt.keep_one_of_each(edge)
    assert left.columns == edge.columns
    # one row of each component, a repeated row too, and all rows without shingles
    assert Counter(r[0] for r in left.collect()) == Counter(d for (d, n, c), m in want.items() for _ in range(m if not n else 1) if d == c or not n)


def test_one_row_of_each_by_row_not_by_id(spark):
    """Ids 1, 2, 2 and two without: the text that shares nothing stays, and one of each group of copies."""
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a, 7), (2, a + " more", 7), (2, "a text of its own that shares nothing", 7), (None, b, 7), (None, b + " more", 7), (9, "", 7), (9, None, 7), (5, "same row", 7), (5, "same row", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    left = pt.keep_one_of_each(docs)
    assert left.columns == docs.columns
    got = left.collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 2, None, 9, 9, 5])
    assert {r.text for r in got if r.doc_id == 2} == {"a text of its own that shares nothing"}


def test_trie_overlaps_against_sets():
    x = np.random.default_rng(5)
    center = np.sort(x.choice(4000, 300, replace=False)).astype(np.int64)
    members = []
    for k in range(120):
        keep = center[x.random(300) < 0.7 + 0.3 * x.random()]
        members.append(np.unique(np.append(keep, x.choice(4000, int(x.integers(0, 40))))).astype(np.int64))
    members.sort(key=lambda m: (m.view(np.uint64) ^ pt._SIGN).astype(">u8").tobytes())
    got = pt.trie_overlaps(center, members)
    want = [100 * len(np.intersect1d(center, m)) >= 80 * len(np.union1d(center, m)) for m in members]
    assert got == want and any(got) and not all(got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (202, 201)]
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in (200, 201, 202)}}


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "exact_copies", "near_copies", "mixing", "packing"]
    good = {r.doc_id for r in cp.quality(spark, docs, sf).collect()}
    scores = {r.doc_id for r in qda.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert good == scores
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    lower = defaultdict(list)
    for d, t in rows:
        lower["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append(d)
    rows = [(d, t) for d, t in rows if d in {max(v) for v in lower.values()}]
    rows = [(d, t) for d, t in rows if (d, d) in {(x, c) for x, _, c in _brute(rows)}]
    out = cp.run(spark, sf).collect()
    _check_packed(out, rows)


def test_pipeline_keeps_edges(spark, edge, edge_rows):
    import corpus_pipeline as cp

    for name, f in cp.STAGES[1:4]:
        assert f(spark, edge, "").columns == edge.columns, name
    assert cp.exact_copies(spark, edge, "").count() == len({(r[1] or "").translate({c: c + 32 for c in range(65, 91)}) for r in edge_rows})


def test_pipeline_windows_follow_the_mix(spark):
    import corpus_pipeline as cp

    rows = [(i, prose(i, 250), "en", "web" if i % 10 < 7 else "code" if i % 10 < 9 else "books", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.packing(spark, cp.mixing(spark, docs, ""), "").collect()
    _check_packed(out, [r[:2] for r in rows])
    weights = {s: n**0.7 for s, n in Counter(r[3] for r in rows).items()}
    for took in _took(out, 20):
        assert all(abs(took[s] - LENGTH * w / sum(weights.values())) < 6 for s, w in weights.items())


def _by_queue(out):
    queues = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            queues[r.queue].append(r.doc_id)
    return queues


def test_pack_follows_a_given_order(spark, empty):
    rows = [(i, prose(i, 20 + i % 300), f"s{i % 3}", (i * 37) % 101) for i in range(101)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place long").repartition(6)
    out = pack(docs, PATH, {"s0": 1.0, "s1": 2.0, "s2": 3.0}, order=["place"], length=256).collect()
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())
    got = _by_queue(out)
    for s in ("s0", "s1", "s2"):
        assert got[s] == [r[0] for r in sorted(rows, key=lambda r: r[3]) if r[2] == s]
    assert pack(empty, PATH, order=["idx"]).count() == 0


def test_packing_follows_the_mixing_stage_as_it_was_written(spark, tmp_path):
    import corpus_pipeline as cp

    rows = [(i, prose(i, 60 + i % 50), "en", "big" if i % 10 else "small", 60) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    down = F.col("doc_id").desc()  # any order that a mixing stage may choose
    docs.repartitionByRange(5, down).sortWithinPartitions(down).write.parquet(f"{tmp_path}/mixed")
    got = _by_queue(cp.packing(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect())
    for source in ("big", "small"):
        assert got[source] == sorted((r[0] for r in rows if r[3] == source), reverse=True)
    cp.mixing(spark, docs, "").write.parquet(f"{tmp_path}/own")
    place = {r.doc_id: r.position for r in mix(docs).collect()}
    got = _by_queue(cp.packing(spark, spark.read.parquet(f"{tmp_path}/own"), "").collect())
    assert all(q == sorted(q, key=place.get) for q in got.values()) and sum(map(len, got.values())) == 400
