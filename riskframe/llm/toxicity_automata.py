"""Toxicity by Levenshtein automata over a lexicon trie, with the words around each hit.

The lexicon is learned: words, and beginnings of words ("abcd*"), that labelled toxic texts hold and clean ones do not,
taken in turn as long as they explain toxic texts that no ``COVER`` earlier terms do (a word and its beginnings count
once). It is stored as a trie. A word of a text is looked up by walking the
trie with the states of a Levenshtein automaton (position in the word, errors so far), so all terms within one edit (two
for long terms) are found in one walk that ends where no state is left. A word that clean texts hold near a term is spared by
name; a term near which many clean texts have a word accepts exact hits only, and its misses go to the next term in reach.

A hit counts by its context of ``WINDOW`` words: within quotation marks or next to a word of reporting it speaks of the
term, next to a word of address it uses it. The counts feed a logistic curve fitted to the labels. The fit reads at
most ``FIT_ROWS`` labelled texts; scoring is one pass without a shuffle, and each worker remembers the words it has looked up.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.quality_qda import held_out, labelled_sample
from riskframe.session import stage

FIT_ROWS = 20_000
CUT = 0.5
COVER = 3
LEAST = 3  # toxic texts that must hold a term
LONG = 9  # terms from this length on allow two edits
SHORTEST = 4
WINDOW = 5
PURE = 20  # times as frequent in toxic texts as in clean ones
LOOSE = 0.0005  # share of clean texts with a word near a term that the term may have and still forgive
HELD = 500_000  # looked-up words a worker remembers, about 60 MB
ROWS = 500

WORD = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»"
REPORT = frozenset("said says wrote writes quoted quote called word term slur insult zitat sagte schrieb wort dit écrit mot cita dijo escribió palabra".split())
ADDRESS = frozenset("you your yours you're u ur du dich dein deine ihr euch tu te toi ton vous votre tú usted vosotros eres".split())


STEMS = range(4, 8)  # lengths of beginnings


def allowed(term: str) -> int:
    """Edits that a term forgives; a beginning, which forgives any ending already, takes two letters more for each."""
    n = len(term) - 3 if term.endswith("*") else len(term)
    return 2 if n >= LONG else 1 if n >= SHORTEST else 0


def units(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    words = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    term: str | None = None
    stem: str | None = None  # a beginning that ends here
    edits: int = 0  # the most that any term below allows
    term_edits: int = 0
    stem_edits: int = 0


def trie(terms) -> Node:
    root = Node()
    for t in terms:
        node, k = root, allowed(t)
        root.edits = max(root.edits, k)
        for c in t.rstrip("*"):
            node = node.next.setdefault(c, Node())
            node.edits = max(node.edits, k)
        if t.endswith("*"):
            node.stem, node.stem_edits = t, k
        else:
            node.term, node.term_edits = t, k
    return root


def _closed(states: dict[int, int], n: int, k: int) -> dict[int, int]:
    """With the states that skip letters of the word."""
    for i in sorted(states):
        e = states[i]
        while i < n and e < k:
            i, e = i + 1, e + 1
            if states.get(i, k + 1) <= e:
                break
            states[i] = e
    return states


def _step(states: dict[int, int], word: str, c: str, k: int) -> dict[int, int]:
    """Automaton states after the trie's letter c."""
    out: dict[int, int] = {}
    for i, e in states.items():
        if i < len(word) and word[i] == c:
            if out.get(i + 1, k + 1) > e:
                out[i + 1] = e
        elif e < k and i < len(word) and out.get(i + 1, k + 1) > e + 1:
            out[i + 1] = e + 1
        if e < k and out.get(i, k + 1) > e + 1:
            out[i] = e + 1
    return _closed(out, len(word), k)


def in_reach(root: Node, word: str) -> list[tuple[int, str]]:
    """(edits, term) of every term that forgives the edits to the word."""
    out = []
    stack = [(root, _closed({0: 0}, len(word), root.edits))]
    while stack:
        node, states = stack.pop()
        if node.term is not None and states.get(len(word), node.term_edits + 1) <= node.term_edits:
            out.append((states[len(word)], node.term))
        if node.stem is not None and min(states.values()) <= node.stem_edits:
            out.append((min(states.values()), node.stem))
        for c, child in node.next.items():
            after = _step(states, word, c, child.edits)
            if after:
                stack.append((child, after))
    return out


def nearest(root: Node, word: str) -> tuple[str, int] | None:
    """The term with the fewest edits to the word among those that forgive so many; ties go to the first in order."""
    best = min(in_reach(root, word), default=None)
    return (best[1], best[0]) if best else None


DEPTH = 4  # letters of the trie walked to see whether a word's beginning leads anywhere


def leads_on(root: Node, head: str) -> bool:
    """Whether some word that begins with ``head`` keeps a state alive down to ``DEPTH`` letters, or meets a term before.

    The states there reach at most ``DEPTH`` plus the edits into the word, so a head of that length decides.
    """
    stack = [(root, 0, _closed({0: 0}, len(head), root.edits))]
    while stack:
        node, depth, states = stack.pop()
        if depth == DEPTH or node.term is not None or node.stem is not None:
            return True
        for c, child in node.next.items():
            after = _step(states, head, c, child.edits)
            if after:
                stack.append((child, depth + 1, after))
    return False


class Finder:
    """Looks words up in the lexicon; remembers the answers, and which beginnings of words lead nowhere."""

    def __init__(self, terms, exact_only=frozenset(), spared=frozenset()):
        self.root, self.spared = trie(t for t in terms if t not in exact_only), spared
        # terms for exact hits only need no walk
        self.exact = {t for t in terms if t in exact_only}
        self.stems = sorted({len(t) - 1 for t in self.exact if t.endswith("*")})
        self.held: dict[str, int] = {}
        self.heads: dict[str, bool] = {}
        self.head = DEPTH + self.root.edits

    def in_reach(self, word: str) -> list[tuple[int, str]]:
        out = [(0, word)] if word in self.exact else []
        out += [(0, word[:k] + "*") for k in self.stems if len(word) >= k and word[:k] + "*" in self.exact]
        return out + self._walked(word)

    def _walked(self, word: str) -> list[tuple[int, str]]:
        if len(word) > self.head:
            head = word[: self.head]
            alive = self.heads.get(head)
            if alive is None:
                if len(self.heads) >= HELD:
                    self.heads.clear()
                alive = self.heads[head] = leads_on(self.root, head)
            if not alive:
                return []
        return in_reach(self.root, word)

    def look(self, word: str) -> int | None:
        """Edits to the nearest term, or None; a spared word has none but exact hits."""
        best = min(self.in_reach(word), default=None)
        return None if best is None or (best[0] and word in self.spared) else best[0]

    def edits(self, words: list[str]) -> list[int]:
        """Edits of each word to its nearest term, -1 without one; new words are looked up once and remembered."""
        out = list(map(self.held.get, words))
        if None in out:
            for i in [i for i, e in enumerate(out) if e is None]:
                w = words[i]
                e = self.held.get(w)
                if e is None:
                    got = self.look(w)
                    e = self.held[w] = -1 if got is None else got
                out[i] = e
            if len(self.held) > HELD:
                self.held.clear()
        return out

    def features(self, text: str | None) -> list[float]:
        """Hits per kind (plain, quoted, addressed, misspelled), on a log scale, and their density."""
        low = (text or "").lower()
        words = WORD.findall(low)
        edits = self.edits(words)
        at = [(i, e) for i, e in enumerate(edits) if e >= 0] if edits and max(edits) >= 0 else []
        kinds = [0.0, 0.0, 0.0, 0.0]
        if at:
            spans = [m.start() for m in WORD.finditer(low)]
            marks = [m.start() for m in re.finditer(f"[{QUOTES}]", low)]
            for i, e in at:
                kinds[self._kind(words, spans, marks, i)] += 1
                kinds[3] += e > 0
        return [*np.log1p(kinds).tolist(), float(np.log1p(100 * len(at) / (len(words) + 20)))]

    @staticmethod
    def _kind(words, spans, marks, i) -> int:
        near = words[max(0, i - WINDOW) : i + WINDOW + 1]
        begin = int(np.searchsorted(marks, spans[i]))
        low, high = spans[max(0, i - WINDOW)], spans[min(len(spans) - 1, i + WINDOW)]
        # an odd number of quotation marks before, and both ends inside the window
        quoted = begin % 2 == 1 and marks[begin - 1] >= low - 2 and begin < len(marks) and marks[begin] <= high + 40
        if quoted or any(w in REPORT for w in near):
            return 1
        return 2 if any(w in ADDRESS for w in near) else 0


def kin(a: str, b: str) -> bool:
    """Whether one of two units is the other or a beginning of it."""
    if len(b) < len(a):
        a, b = b, a
    return a == b or (a.endswith("*") and b.startswith(a[:-1])) or (b.endswith("*") and a == b[:-1])


def lexicon(toxic: list[set[str]]) -> list[str]:
    """Terms by greedy cover: the most frequent word first, counted over texts not yet covered by ``COVER`` words.

    A word and its beginnings cover a text once. A beginning brings the words that it stands for, since whole words
    forgive more edits.
    """
    holds: dict[str, list[int]] = {}
    for i, t in enumerate(toxic):
        for w in t:
            holds.setdefault(w, []).append(i)
    gain, out = {w: len(h) for w, h in holds.items()}, set()
    told: list[set[str]] = [set() for _ in toxic]  # units that gain nothing more from a text
    left = [COVER] * len(toxic)
    while gain:
        w = max(gain, key=lambda x: (gain[x], x))
        if gain.pop(w) < LEAST:
            break
        out.add(w)
        if w.endswith("*"):
            out.update(v for i in holds[w] for v in toxic[i] if not v.endswith("*") and v.startswith(w[:-1]))
        for i in holds[w]:
            if w in told[i] or not left[i]:
                continue
            left[i] -= 1
            now = {v for v in toxic[i] if v not in told[i] and (not left[i] or kin(v, w))}
            told[i] |= now
            for v in now:
                if v in gain:
                    gain[v] -= 1
    return sorted(out)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights and bias by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: list[str]
    exact_only: frozenset
    weights: np.ndarray | None
    spared: frozenset = frozenset()

    def finder(self) -> Finder:
        return Finder(self.terms, self.exact_only, self.spared)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.hstack([x, np.ones((len(x), 1))]) @ self.weights, -40, 40)))


def _per_text(sample: DataFrame, of, schema: str) -> DataFrame:
    """Rows that ``of(text, y)`` gives for each sampled text."""

    def work(batches):
        for b in batches:
            yield _batch([r for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()) for r in of(t or "", y)], schema)

    return sample.mapInArrow(work, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema.split(",")]
    return pa.RecordBatch.from_pydict({f.split()[0]: pa.array(list(c), _ARROW[f.split()[1]]) for f, c in zip(schema.split(","), cols)})


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, bad, good): toxic and clean sampled texts that hold it, counted per batch before the shuffle."""

    def work(batches):
        for b in batches:
            count: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                count[y].update(units(t or ""))
            rows = [(w, count[1][w], count[0][w]) for w in {*count[0], *count[1]}]
            for i in range(0, len(rows), 50_000):
                yield _batch(rows[i : i + 50_000], "unit string, bad int, good int")

    return sample.mapInArrow(work, "unit string, bad int, good int").groupBy("unit").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64())}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, near misses and curve from the distinct texts of a bounded sample, in passes over it.

    What meets on the driver: pure words, the lists of them in toxic texts, words near them, and five numbers per sampled text.
    """
    sample = stage(labelled_sample(docs, labels, "toxic", 5, 0, FIT_ROWS).groupBy("text").agg(F.max("y").alias("y")).repartition("text"))
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(0) or not n.get(1):
        return Model([], frozenset(), None)
    pure = _unit_counts(sample).filter((F.col("bad") >= LEAST) & (F.col("bad") / n[1] >= PURE * (F.col("good") + 0.25) / n[0]))
    fit_units = {r["unit"] for r in pure.select("unit").collect()}
    lists = _per_text(sample.filter("y = 1"), lambda t, y: [(sorted(units(t) & fit_units),)], "words array<string>")
    terms = lexicon([set(r["words"]) for r in lists.orderBy("words").collect()])
    if not terms:
        return Model([], frozenset(), None)
    near = _per_text(sample, _near_words(terms), "word string, y int").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    wrong, spared = forgiving([tuple(r) for r in near.filter("good > 0").collect()], terms, n)
    held: dict[str, Finder] = {}
    rows = _per_text(sample, lambda t, y: [((held.get("f") or held.setdefault("f", Finder(terms, wrong, spared))).features(t), y)], "x array<double>, y int").toPandas()
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy()
    order = np.lexsort((y, *x.T))  # sums in one order, whatever the tasks' order was
    return Model(terms, wrong, logistic(x[order], y[order]), spared)


def forgiving(near: list[tuple[str, int, int]], terms: list[str], n: dict[int, int]) -> tuple[frozenset, frozenset]:
    """(terms for exact hits only, words to spare) from (word, toxic texts, clean texts) of words near a term.

    A word is spared unless it is as pure as a term's word must be. A term is for exact hits only when more than ``LOOSE`` of
    the clean texts hold a word near it, and its misses together are not pure.
    """
    finder, misses = Finder(terms), Counter()
    spared, toxic = set(), Counter()
    for word, bad, good in near:
        if bad / n[1] < PURE * good / n[0]:
            spared.add(word)
        for _, term in finder.in_reach(word):
            misses[term] += good
            toxic[term] += bad
    wrong = frozenset(t for t, good in misses.items() if good > LOOSE * n[0] and toxic[t] / n[1] < PURE * good / n[0])
    return wrong, frozenset(spared)


def _near_words(terms: list[str]):
    """Words of a text in reach of a term but none themselves; each is looked up once per worker."""
    held: dict[str, Finder] = {}

    def of(text: str, y: int):
        finder = held.get("f") or held.setdefault("f", Finder(terms))
        words = sorted(set(WORD.findall(text.lower())))
        return [(w, y) for w, e in zip(words, finder.edits(words)) if e > 0]

    return of


def scorer(model: Model):
    held: dict[str, Finder] = {}

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if model.weights is None:
            return pd.Series(np.zeros(len(text)))
        finder = held.get("finder") or held.setdefault("finder", model.finder())
        return pd.Series(model.score(np.array([finder.features(t) for t in text]).reshape(len(text), 5)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``CUT`` up).

    Texts alone decide a score: null and empty texts share one, equal texts too, and repeated rows each keep theirs. Without
    toxic or without clean labelled texts every score is 0. An empty table gives an empty result.
    """
    score = scorer(learn(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
