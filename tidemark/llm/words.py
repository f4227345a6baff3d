"""Words of whole texts as 64-bit hashes, for operators that compare or count words in tasks."""

from __future__ import annotations

import string

import numpy as np
import xxhash

_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation and white space part them."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out
