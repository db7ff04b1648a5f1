"""A minimal perfect hash over 64-bit keys, built and asked in whole arrays.

Levels of bit arrays: at each level a key falls on one of GAMMA * n bits by a seeded
mix; keys alone on their bit keep it, the others go on to the next level. The number of a
key is the count of set bits before its own, over all levels: 0..n-1, each once.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
LEVELS = 40
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
STEP = 0x9E3779B97F4A7C15


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((STEP * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.bases = np.concatenate([[0], np.cumsum([(s + 63) // 64 for s in sizes])]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """keys: distinct 64-bit integers."""
        left, sizes, parts = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) >= LEVELS:
                raise ValueError("keys repeat")
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            counts = np.bincount(at, minlength=size)
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = counts == 1
            parts.append(np.packbits(bits, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[counts[at] != 1]
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for keys that surely are not among those built. Others
        that were not built may get any number: compare a stored fingerprint."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word = self.bases[level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            found = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[open_[found]] = self.before[word[found]] + np.bitwise_count(below)
            open_ = open_[~found]
            if not len(open_):
                break
        return out
