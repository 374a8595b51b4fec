"""Word shingles of whole texts as 64-bit hashes, vectorised per text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from barlens.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_COEF = mix64(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def _hash_words(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word: a polynomial over the word's bytes, from prefix sums modulo 2**64."""
    inside = ~_SPACE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = _powers(max(17, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)])
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased, in order."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    if len(raw) <= _BLOCK:
        return _hash_words(raw)
    parts, at = [], 0
    while at < len(raw):  # cut long texts at white space, so that no word is split
        to = at + _BLOCK
        while to < len(raw) and not _SPACE[raw[to]]:
            to += 1
        parts.append(_hash_words(raw[at:to]))
        at = to
    return np.concatenate(parts)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; with fewer words the whole sequence is one; without words, empty."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(k, len(w))
    acc = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        acc += w[i: len(w) - k + 1 + i] * _COEF[i]
    return np.unique(mix64(acc))
