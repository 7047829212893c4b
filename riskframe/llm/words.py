"""Hashed words and shingles of a batch of texts, by whole-array numpy steps.

Words are the runs between the ASCII spaces \\x20 and \\x09-\\x0D of the UTF-8 bytes, after lower-casing A-Z.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


_WEIGHTS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def batch_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with one space after each, and where each ends."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    return _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)] if raw else np.zeros(0, np.uint8), ends.astype(np.int64)


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each text and after the last).

    A word's hash is a random linear form of its bytes modulo 2**64, 64 bytes at a time, finalised with its length.
    """
    buf, ends = batch_bytes(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    gap = _GAP[buf]
    before = np.empty(len(gap), dtype=bool)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(ends) + 1, np.int64)
    inside = np.flatnonzero(~gap)
    first = np.searchsorted(inside, starts)  # where each word begins among the bytes of words
    lens = np.diff(np.append(first, len(inside)))
    at = np.arange(len(inside)) - np.repeat(first, lens)
    # long words: each stretch of 64 bytes has its own multiplier
    terms = (buf[inside].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[at & 63]
    if (at > 63).any():
        terms *= mix64((at >> 6).astype(np.uint64)) | np.uint64(1)
    hashes = mix64(np.add.reduceat(terms, first) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, np.append(0, np.searchsorted(starts, ends)).astype(np.int64)


def shingles(texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, bounds): sorted within each text; fewer than ``k`` words give one of the whole sequence."""
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    padded = np.append(words, np.zeros(k, np.uint64))
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.arange(n) - bounds[doc]
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            value += np.where(pos + i < counts[doc], padded[i : i + n], np.uint64(0)) * _WEIGHTS[i + 40]
    value = mix64(value)
    keep = (pos + k <= counts[doc]) | (pos == 0)
    value, doc = value[keep], doc[keep]
    ends = np.cumsum(np.bincount(doc, minlength=len(counts)))
    for lo, hi in zip(ends - np.bincount(doc, minlength=len(counts)), ends):
        value[lo:hi].sort()
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.append(0, np.cumsum(np.bincount(doc, minlength=len(counts)))).astype(np.int64)
