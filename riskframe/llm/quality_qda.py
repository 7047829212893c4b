"""Quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector: smoothed shares of letters, marks, repeats and the like, over the whole text and over
its worst line, on a log scale. Each class gets a mean and a covariance, shrunk towards the pooled diagonal; the score
compares the classes' log densities, by Mahalanobis distances through Cholesky factors that are worked out once and sent
with the model, and a logistic curve fitted to the difference gives a number from 0 to 1.

The fit reads at most ``FIT_ROWS`` labelled texts, the first by a hash of their id. Scoring is one pass over all texts
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import give_back, text_steps
from riskframe.llm.words import word_hashes

FIT_ROWS = 20_000
KEEP = 0.7
SHRINK = (0.02, 0.1, 0.3, 0.6)
ROWS = 500  # texts per step, and
STEP = 1_000_000  # characters, bound the arrays in a worker
SOFT = 12.0  # pseudo-counts under each share, so that short texts are not judged by a few characters

_KIND = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower or beyond ASCII, 3 digit, 4 space, 5 mark of a sentence, 6 symbol
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 1, 2, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 5
_KIND[[ord(c) for c in "!|#$%&*@^~=+<>{}[]\\/_`"]] = 6


def _sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)


def statistics(texts) -> np.ndarray:
    """One row of statistics per text; null counts as empty."""
    raw = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    n = len(raw)
    if not n:
        return np.zeros((0, 14))
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    starts = np.append(0, np.cumsum(size)[:-1])
    kind = _KIND[buf]
    wide = np.zeros(len(buf), bool)
    wide[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)  # capital Latin letters beyond ASCII
    upper, lower, digit, mark, symbol = (kind == 1) | wide, (kind == 2) & ~wide, kind == 3, kind == 5, kind == 6
    lines = np.append(0, np.flatnonzero(buf[:-1] == 10) + 1)
    line_of = np.searchsorted(starts, lines, side="right") - 1
    odd_line = _sums(upper | symbol, lines) / (_sums(kind != 4, lines) + 2 * SOFT)
    worst = np.zeros(n)
    np.maximum.at(worst, line_of, odd_line)
    letters = _sums(upper | lower, starts)
    chars = _sums(kind != 4, starts)

    words, bounds = word_hashes(texts)
    count = np.diff(bounds)
    doc = np.repeat(np.arange(n), count)

    def back(k: int) -> np.ndarray:  # words equal to the one k before, in the same text
        same = np.zeros(len(words), bool)
        if len(words) > k:
            same[k:] = (words[k:] == words[:-k]) & (doc[k:] == doc[:-k])
        return np.bincount(doc[same], minlength=n)

    order = np.lexsort((words, doc))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    share = lambda a, b: np.log((a + 0.02 * SOFT) / (b + SOFT))
    bang, bar = _sums(buf == 33, starts), _sums(buf == 124, starts)
    return np.stack(
        [
            np.log1p(count), np.log((chars + 5 * SOFT) / (count + SOFT)), share(_sums(upper, starts), letters), share(_sums(symbol, starts) - bang - bar, chars),
            share(bang, chars), share(bar, chars), share(_sums(digit, starts), chars), share(_sums(mark, starts), chars), share(back(1), count),
            share(back(2) + back(3), count), np.log((distinct + SOFT) / (count + SOFT)), np.log(worst + 0.02), share(_sums(kind == 0, starts), chars), share(_sums(buf == 10, starts), count),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    mean: list[np.ndarray]
    factor: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    offset: list[float]
    slope: float
    bias: float

    def difference(self, x: np.ndarray) -> np.ndarray:
        dens = []
        for c in (0, 1):
            z = (x - self.mean[c]) @ self.factor[c].T
            dens.append(self.offset[c] - 0.5 * (z * z).sum(axis=1))
        # beyond this the curve is flat; the bound keeps the fit and the exponential finite
        return np.clip(dens[1] - dens[0], -60, 60)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.difference(x) + self.bias)))


def _classes(x: np.ndarray, y: np.ndarray, shrink: float) -> Discriminant:
    centred = np.concatenate([x[y == c] - x[y == c].mean(axis=0) for c in (0, 1)])
    pooled = np.diag(centred.var(axis=0) + 1e-4)
    mean, factor, offset = [], [], []
    for c in (0, 1):
        own = x[y == c]
        cov = (1 - shrink) * np.cov(own.T, bias=True) + shrink * pooled + 1e-6 * np.eye(x.shape[1])
        low = np.linalg.cholesky(cov)
        mean.append(own.mean(axis=0))
        factor.append(np.linalg.inv(low))
        offset.append(float(np.log(len(own) / len(x)) - np.log(np.diag(low)).sum()))
    return Discriminant(mean, factor, offset, 1.0, 0.0)


def _curve(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a small penalty."""
    x, w = np.stack([d / 10, np.ones(len(d))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - 0.01 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), grad)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / 10), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant | None:
    """The shrinkage with the least log loss on every fourth row, then refitted on all; None without two rows a class."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    aside = np.arange(len(y)) % 4 == 3

    def loss(shrink: float) -> float:
        m = _classes(x[~aside], y[~aside], shrink)
        m.slope, m.bias = _curve(m.difference(x[~aside]), y[~aside])
        p = np.clip(m.score(x[aside]), 1e-6, 1 - 1e-6)
        return float(-(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).mean())

    checked = all((y[~aside] == c).sum() >= 2 for c in (0, 1)) and aside.sum() >= 20
    model = _classes(x, y, min(SHRINK, key=loss) if checked else SHRINK[-1])
    model.slope, model.bias = _curve(model.difference(x), y)
    return model


def held_out(key: Column, folds: int, fold: int) -> Column:
    """Whether the id's CRC-32 falls into the fold; a null id counts as the text "null"."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int = FIT_ROWS) -> DataFrame:
    """(id, text, y) of at most ``rows`` labelled rows outside the held-out fold; ids labelled twice take the larger label."""
    lab = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    first = lab.filter(~held_out(F.col("id"), folds, fold)).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(first), "id")  # at most ``rows`` rows of 12 bytes


def learn(docs: DataFrame, labels: DataFrame) -> Discriminant | None:
    sample = labelled_sample(docs, labels, "quality", 4, 2)

    def work(batches):
        for whole in batches:
            for b in text_steps([whole], STEP):
                x = statistics(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], names=["id", "y", "x"])

    got = sample.mapInArrow(work, "id long, y int, x array<double>").orderBy("id").toPandas()
    return fit(np.array(got["x"].tolist()), got["y"].to_numpy()) if len(got) else None


def _steps(texts: list) -> Iterator[list]:
    """At most ``ROWS`` texts of about ``STEP`` characters together, one at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if i > lo and (size > STEP or i - lo == ROWS):
            yield texts[lo:i]
            lo, size = i, len(t or "")
    if texts:
        yield texts[lo:]


def scorer(model: Discriminant | None):
    """A column function from text to score; without a model every text scores 0.5."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(text), 0.5))
        out = [model.score(statistics(part)) for part in _steps(text.tolist())]
        give_back()
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``KEEP`` up).

    Texts alone decide a score: null and empty texts share one, rows with equal texts too, and repeated rows each keep
    theirs. With fewer than two labelled texts of a class every score is 0.5. An empty table gives an empty result.
    """
    score = scorer(learn(docs, labels))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier does not reject, with the columns they came with; all rows if no classifier can be fitted."""
    model = learn(docs, labels)
    if model is None:
        return docs
    score = scorer(model)
    kept = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("load"), score(F.col("text").cast("string")).alias("score")).filter(F.col("score") >= KEEP)
    return kept.select("load.*")
