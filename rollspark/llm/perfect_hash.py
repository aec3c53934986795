"""A minimal perfect hash over 128-bit digests, in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class SlotTable:
    """Gives each of n distinct digests (two 64-bit halves) a slot of its own in 0 .. n-1.

    A level is a bit array about 1.5 times as long as the keys it sees. Keys that hit a bit alone stay there, the others go
    on to the next level; a key's slot is the rank of its bit. A slot keeps the digest it was given for, and a look-up
    compares it, so a digest that is not in the table is told apart (slot -1) and never takes another one's place.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, room: float = 1.5, most_levels: int = 64):
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        self.n, self.levels, base = len(a), [], 0
        left = np.arange(self.n)
        while len(left):
            if len(self.levels) >= most_levels:
                raise ValueError("two equal digests in one table")
            size = int(len(left) * room) + 1
            at = self._spot(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            ranks = np.cumsum(alone) - 1 + base
            self.levels.append((size, alone, ranks))
            base += int(alone.sum())
            left = left[~alone[at]]
        self.a, self.b = np.empty(self.n, np.uint64), np.empty(self.n, np.uint64)
        slot = self._walk(a, b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _spot(a, b, level: int, size: int) -> np.ndarray:
        x = (a ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _M1
        x = (x ^ (x >> np.uint64(32)) ^ b) * _M2
        return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _walk(self, a, b) -> np.ndarray:
        slot = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (size, alone, ranks) in enumerate(self.levels):
            at = self._spot(a[left], b[left], level, size)
            hit = alone[at]
            slot[left[hit]] = ranks[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return slot

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The digests' slots; -1 for those that the table does not hold."""
        a, b = a.astype(np.uint64), b.astype(np.uint64)
        slot = self._walk(a, b)
        if self.n:
            same = (slot >= 0) & (self.a[slot] == a) & (self.b[slot] == b)
            slot[~same] = -1
        return slot
