"""A minimal perfect hash of 64-bit keys: bit levels and ranks, all steps on arrays."""

from __future__ import annotations

import numpy as np

from strandwork.llm.text import U64, mix

#: Bits of a level for each key that is left.
GAMMA = 2.0
_LEVEL = 0xD6E8FEB86659FD93
_ONE = U64(1)


class PerfectHash:
    """Gives each of n distinct keys a slot of its own below n; any other key gets some slot or -1, so compare stored keys.

    In a level every key has a place. Where a key is alone its bit is set, and its slot is the number of bits before it;
    the others go to the next level.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, self.n = [], len(keys)
        left, base = keys.astype(U64, copy=False), 0
        while len(left):
            if len(self.levels) > 64:
                raise ValueError("two keys are equal")
            size = max(64, -(-int(len(left) * GAMMA) // 64) * 64)
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view(U64)
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((bits, base + np.cumsum(ones) - ones, size))
            base += int(ones.sum())
            left = left[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U64((level + 1) * _LEVEL & 0xFFFFFFFFFFFFFFFF)) % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(U64, copy=False)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before, size) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(keys[open_], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(U64)
            here = (word >> bit & _ONE).astype(bool)
            below = np.bitwise_count(word & ((_ONE << bit) - _ONE)).astype(np.int64)
            out[open_[here]] = (before[at >> 6] + below)[here]
            open_ = open_[~here]
        return out
