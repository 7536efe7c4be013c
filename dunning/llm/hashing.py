"""A table from 64-bit keys to numbers that numpy looks up whole arrays in."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """Open addressing at a quarter full; key 0 is not allowed."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        keys = keys.astype(np.uint64)
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), np.int64((1 << bits) - 1), missing
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, missing, np.int64)
        left = np.arange(len(keys))
        at = ((keys * _ODD) >> self.shift).astype(np.int64)
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]  # of several for one place the last stays
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * _ODD) >> self.shift).astype(np.int64)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.missing)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there != 0)]
        return out
