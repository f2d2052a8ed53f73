"""Hashed byte n-gram counts of whole texts, in numpy."""

from __future__ import annotations

from operator import eq

import numpy as np

_STEP, _SPREAD = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def _shapes() -> np.ndarray:
    """Byte to class: any small letter or non-ASCII byte, any capital, any digit; other bytes stand for themselves."""
    out = np.arange(256, dtype=np.uint64)
    out[ord("a") : ord("z") + 1] = ord("a")
    out[128:] = ord("a")
    out[ord("A") : ord("Z") + 1] = ord("A")
    out[ord("0") : ord("9") + 1] = ord("0")
    return out


SHAPES = _shapes()


def ngram_counts(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Counts of the n-grams of a uint64 sequence in 2**bits hash buckets."""
    if len(values) < n:
        return np.zeros(1 << bits, np.float32)
    m = len(values) - n + 1
    h = values[:m].copy()
    for i in range(1, n):
        h *= _STEP
        h += values[i : i + m]
    h *= _SPREAD
    h >>= np.uint64(64 - bits)
    return np.bincount(h.view(np.int64), minlength=1 << bits).astype(np.float32)


def quality_features(text: str | None, bits: int = 11) -> np.ndarray:
    """Square roots of the shares of byte trigrams and shape 4-grams, and of repeated words; zeros for no text."""
    data = (text or "").encode()
    raw = np.frombuffer(data, dtype=np.uint8)
    words = data.lower().split()
    out = np.zeros(2 * (1 << bits) + 2, np.float32)
    for part, counts in ((0, ngram_counts(raw.astype(np.uint64), 3, bits)), (1, ngram_counts(SHAPES[raw], 4, bits))):
        out[part << bits : (part + 1) << bits] = np.sqrt(counts / max(counts.sum(), 1))
    if len(words) > 1:
        out[-2] = (sum(map(eq, words, words[1:])) / (len(words) - 1)) ** 0.5
        out[-1] = 1 - out[-2]
    return out
