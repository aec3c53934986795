"""Texts that say the same thing three times in a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_P = np.uint64(0x9E3779B97F4A7C15)


def has_triple(text: str, least: int = 30) -> bool:
    """Whether some stretch of ``least`` or more characters without a line end stands three times in a row.

    The same answer as the pattern ``(.{30,}?)\\1\\1``, in n log n steps: if a stretch of length L is tripled, its first
    ``least`` characters occur three times, and of the places 0, L, 2L, ... two neighbours lie in it, around which
    the text agrees with itself, L further on, for 2L characters and more.
    """
    return any(_line_has(line, least) for line in text.split("\n") if len(line) >= 3 * least)


def _line_has(line: str, least: int) -> bool:
    s = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = _windows(s, least)
    kinds, counts = np.unique(grams, return_counts=True)
    often = kinds[counts >= 3]
    if not len(often):
        return False
    spots = np.flatnonzero(np.isin(grams, often))
    n = len(s)
    # Lengths lie between the nearest and the farthest of equal grams.
    longest = min(n // 3, int(spots[-1] - spots[0]) // 2)
    for length in range(least, longest + 1):
        a = np.arange(0, n - length, length)
        b = a + length
        # Two thirds of what agrees lie on one side, so a whole gram agrees before or behind.
        ahead = b < len(grams)
        same = np.zeros(len(a), bool)
        same[ahead] = grams[a[ahead]] == grams[b[ahead]]
        behind = a >= least
        same[behind] |= grams[a[behind] - least] == grams[b[behind] - least]
        for i, j in zip(a[same].tolist(), b[same].tolist(), strict=True):
            if _agree(s, i, j, 1, 2 * length) + _agree(s, i - 1, j - 1, -1, 2 * length) >= 2 * length:
                return True
    return False


def _windows(s: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window: windows of 1, 2, 4, ... characters, put together by the bits of ``width``."""
    x = (s.astype(np.uint64) + np.uint64(1)) * _P
    x ^= x >> np.uint64(31)
    out, done, have = None, 0, 1
    while done < width:
        if width & have:
            more = x[done:]
            out = x if out is None else _mixed(out[: len(more)], more)
            done += have
        x = _mixed(x[:-have], x[have:])
        have *= 2
    return out


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _P) ^ (b + (a >> np.uint64(29)))


def _agree(s: np.ndarray, i: int, j: int, way: int, most: int, step: int = 64) -> int:
    """How many characters agree from i and j on in a direction, ``most`` at the most."""
    done = 0
    while done < most:
        k = min(step, most - done)
        a, b = i + way * done, j + way * done
        k = min(k, len(s) - b if way > 0 else a + 1)
        if k <= 0:
            return done
        x, y = (s[a : a + k], s[b : b + k]) if way > 0 else (s[a - k + 1 : a + 1][::-1], s[b - k + 1 : b + 1][::-1])
        off = np.flatnonzero(x != y)
        if len(off):
            return done + int(off[0])
        done, step = done + k, 2 * step
    return done


@F.pandas_udf(BooleanType())
def repeats_in_a_row(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t is not None and has_triple(t)).astype(bool)
