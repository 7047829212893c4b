"""Byte-level BPE ids of whole texts, with the pieces between spaces kept in a bounded store per worker.

A byte-level pre-tokenizer never joins what stands before a space to the space itself, unless the space has white space
on both sides; so a text may be cut before its spaces and each piece be encoded alone. Pieces not seen before are put
in a row and encoded in one call: by tiktoken, several times as fast, when the file is a plain byte-level BPE whose ids
follow its merges (both then give the same ids), else by the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

HELD = 500_000  # pieces kept by a worker, about 100 MB; the store is emptied when full
LONG = 64  # longer pieces are not kept
_UNSAFE = re.compile(r"\s \s")
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


# fixed value: the pattern of byte-level pre-tokenizers
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _plain_bpe(path: str):
    """A tiktoken encoding and the byte length of each id, or None when the file holds more than a plain byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("byte_fallback") and not model.get("end_of_word_suffix")
    if not plain or model.get("ignore_merges") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte_of, added = _byte_of(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or any(c not in byte_of for t in vocab for c in t):
        return None
    import tiktoken

    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for t, i in ranks.items():
        size[i] = len(t)
    return tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}), size


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.held: dict[str, bytes] = {}
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = int(self.kind[-1])
        self.plain = _plain_bpe(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _in_a_row(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that each begin with a space and a letter or mark: their text is cut where they meet."""
        enc, size = self.plain
        ids = np.array(enc.encode_ordinary("".join(pieces)), np.int64)
        ends = np.searchsorted(np.cumsum(size[ids]), np.cumsum([len(p.encode()) for p in pieces])) + 1
        raw, w = ids.astype(self.kind).tobytes(), self.width
        return {p: raw[lo * w : hi * w] for p, lo, hi in zip(pieces, [0, *ends[:-1].tolist()], ends.tolist())}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces. A closing dot or comma after a letter or digit is a token border, so the rest is shared."""
        parts = {p: (p[:-1], p[-1]) if p[-1] in ".," and p[-2:-1].isalnum() else (p,) for p in pieces}
        todo = list(dict.fromkeys(x for two in parts.values() for x in two))
        row = [p for p in todo if len(p) > 1 and p[0] == " " and not p[1].isspace() and not any(t in p for t in self.added)] if self.plain else []
        known = self._in_a_row(row) if row else {}
        todo = [p for p in todo if p not in known]
        known.update((p, np.array(e.ids, self.kind).tobytes()) for p, e in zip(todo, self.tokenizer.encode_batch_fast(todo, add_special_tokens=False)))
        return {p: b"".join([known[x] for x in two]) for p, two in parts.items()}

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text. ``held`` has the pieces that follow a space, without it."""
        if len(self.held) > HELD:
            self.held.clear()
        look, firsts, found, gaps = self.held.get, [], [], set()
        for t in texts:
            t = t or ""
            if _UNSAFE.search(t):
                first, *rest = _SAFE_CUT.split(t)
                rest = [p[1:] for p in rest]
            else:
                first, *rest = t.split(" ")
            ids = list(map(look, rest))
            open_ = [i for i, v in enumerate(ids) if v is None] if None in ids else []
            gaps.update([rest[i] for i in open_])
            firsts.append(first)
            found.append((ids, rest, open_))
        heads = self._learn([p for p in set(firsts) if p])
        more = {p[1:]: v for p, v in self._learn([" " + p for p in gaps]).items()} if gaps else {}
        heads[""] = b""
        for ids, rest, open_ in found:
            for i in open_:
                ids[i] = more[rest[i]]
        self.held.update(more if max(map(len, more), default=0) <= LONG else {p: v for p, v in more.items() if len(p) <= LONG})
        return [heads[first] + b"".join(ids) for first, (ids, _, _) in zip(firsts, found)]

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).astype("<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
