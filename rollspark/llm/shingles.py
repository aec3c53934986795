"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The distinct k-word shingles of a whole text, hashed and sorted.

    A-Z are lower-cased; words are runs of other characters than space and U+0009 to U+000D. Fewer than k words: the whole
    sequence is one shingle. Null, empty or blank text: the empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ (out >> np.uint64(31))) * _M + h[i : i + n]
    out = (out ^ (out >> np.uint64(29))) * _M
    return np.unique(out ^ (out >> np.uint64(32)))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)
