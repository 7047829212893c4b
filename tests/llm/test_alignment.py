"""Fragments of two tokenizers against whole texts encoded by the tokenizers themselves."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from conftest import SCHEMA, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import fragment_alignment as fa

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
TEXTS = [
    None, "", " ", "x", " two  spaces ", "a\n b \nc\t\td", "▁ not a space ▁", "<|endoftext|> and <s> or </s> <0x41>", "héé ça 漢字かな交じり文 🙂🙂 é", "a b c ́d",
    "1234567 12,345.67 don't we'll I'M", "tabs\tand\r\nlines \r\n end", "\x00\x1c\x1d null and separators", "same words same words", "same words same words", prose(4, 300), " ".join("x" * 50 for _ in range(60)), "漢字" * 120,
]


def _whole(text):
    """(ids and ends of A, of B, fine) by the plain tokenizers."""
    import sentencepiece
    from tokenizers import Tokenizer

    from riskframe.llm.bpe import _byte_of

    global _TOOLS
    try:
        tok, sp = _TOOLS
    except NameError:
        tok = Tokenizer.from_file(A)
        tok.encode_special_tokens = True
        sp = sentencepiece.SentencePieceProcessor(model_file=B)
        _TOOLS = tok, sp
    byte_of = _byte_of()
    a = tok.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    raw_a = [bytes(byte_of[c] for c in tok.id_to_token(i)) for i in a]
    raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a, raw_a, b, raw_b, b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode()


def _groups(text):
    if not text:
        return [], 0, 0
    a, raw_a, b, raw_b, ok = _whole(text)
    if not ok:
        return [], 0, 0
    end_of = lambda raw: [sum(map(len, raw[: i + 1])) for i in range(len(raw))]
    ends_a, ends_b = end_of(raw_a), end_of(raw_b)
    out, lo = [], 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        out.append(([i for i, e in zip(a, ends_a) if lo < e <= cut], [i for i, e in zip(b, ends_b) if lo < e <= cut]))
        lo = cut
    return out, len(a), len(b)


def _brute(rows):
    got = [(d, *_groups(t)) for d, t in rows]
    links = [Counter((x, y) for g in gs for x in g[0] for y in g[1]) for _, gs, _, _ in got]
    held = Counter(p for c in links for p in c)
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = Counter()
    for (d, gs, na, nb), c in zip(got, links):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out[(d, na, nb, len(gs), sum(c.values()), sum(k for p, k in c.items() if held[p] == top[p[0]]), sum(k * held[p] for p, k in c.items()), hashlib.sha256(said.encode()).hexdigest() if gs else "")] += 1
    return out


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("chunk, fan, table", [(fa.CHUNK, fa.FAN, fa.PAIRS), (30, 2, 0)])
def test_alignment(spark, monkeypatch, chunk, fan, table):
    monkeypatch.setattr(fa, "FAN", fan)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "x"), (3, "another text of one id")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 1, "x", 1) for d, t in rows], SCHEMA).repartition(4)
    out = fa.align(docs, A, B, chunk=chunk, table=table)
    assert Counter(map(tuple, out.select(*COLS).collect())) == _brute(rows)


def test_alignment_empty(spark, empty):
    assert fa.align(empty, A, B).count() == 0


def test_special_strings_and_bad_bytes():
    al = fa.Aligner(A, B)
    got = al.align(["<|endoftext|>", "▁", "", "fine"])
    assert [g[0] > 0 for g in got] == [True, False, False, True] and got[1][3] == got[2][3] == ""


def test_store_is_bounded(monkeypatch):
    monkeypatch.setattr(fa, "HELD", 5)
    al, texts = fa.Aligner(A, B), [prose(i, 30) for i in range(6)]
    once = [al.align([t])[0] for t in texts]
    assert len(al.at) <= 35
    whole = fa.Aligner(A, B).align(texts)
    assert [x[:4] for x in once] == [x[:4] for x in whole]
    assert all((x[4] == y[4]).all() and (x[5] == y[5]).all() for x, y in zip(once, whole))


ENDS = st.lists(st.integers(1, 40), unique=True, max_size=25).map(sorted)


@settings(max_examples=150, deadline=None)
@given(ENDS, ENDS, st.lists(st.integers(0, 40), min_size=2, max_size=2).map(sorted))
def test_fragments_are_a_monoid(a, b, cuts):
    """Any three ranges compose to the whole, in either order, also where a token reaches over a border."""
    part = lambda lo, hi: fa.fragment(range(len(a)), a, range(100, 100 + len(b)), b, lo, hi)
    x, y, z = part(0, cuts[0]), part(*cuts), part(cuts[1], 40)
    whole = part(0, 40)
    assert fa.compose(fa.compose(x, y), z) == fa.compose(x, fa.compose(y, z)) == whole
    assert fa.compose(whole, fa.Fragment()) == fa.compose(fa.Fragment(), whole) == whole


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é漢\n\t.,'1  ́▁") | st.characters(codec="utf-8"), max_size=40))
def test_words_align_like_the_whole_text(text):
    al = fa.aligner(A, B)
    said, (na, nb, ng, sha, pairs, times) = _groups(text), al.align([text])[0]
    assert (len(said[0]), said[1], said[2]) == (ng, na, nb)
    assert sum(len(x) * len(y) for x, y in said[0]) == times.sum()
    if said[0]:
        assert sha == hashlib.sha256(";".join(map(fa.group_text, said[0])).encode()).hexdigest()
    ok, f = al.chunk(text) if text else (False, fa.Fragment())
    assert not ok or [f.head, *f.groups] == said[0]
    assert text == " ".join(fa.chunks(text, 5))
