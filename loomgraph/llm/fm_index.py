"""FM-index over an array of symbols: wavelet matrix ranks, sampled suffix positions.

Symbol 0 separates runs and ends every comparison: suffixes that agree up to a separator
are ordered by position. That order is the one LF steps keep, so both counting and
locating are exact.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: symbols, 0 last. Prefix doubling; separators are distinct from each other."""
    n = len(text)
    sep = text == 0
    rank = text.astype(np.int64) + np.count_nonzero(sep)
    rank[sep] = np.arange(np.count_nonzero(sep))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (max(int(rank.max()), 1) + 1) + after if step < n else rank
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        # a suffix alone in its rank keeps it; when all are, the order is whole
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class Bits:
    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before position i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels, s = [], symbols
        for bit in reversed(range(max(1, (n_symbols - 1).bit_length()))):  # absent symbols too
            b = (s >> bit) & 1
            self.levels.append((bit, Bits(b), int(len(b) - b.sum())))
            s = np.concatenate([s[b == 0], s[b == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before position i."""
        low, high = np.zeros_like(i), i.copy()
        for bit, bits, zeros in self.levels:
            one = ((symbol >> bit) & 1) == 1
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + ones_low, low - ones_low)
            high = np.where(one, zeros + ones_high, high - ones_high)
        return high - low

    def get(self, i: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(i), np.int64), i.copy()
        for bit, bits, zeros in self.levels:
            one = bits.get(i)
            ones = bits.rank(i)
            out |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return out


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        """text: symbols below n_symbols, the last is 0."""
        sa = suffix_array(text)
        before = text[sa - 1]  # of position 0: the last symbol, a separator
        self.wavelet = WaveletMatrix(before.astype(np.int64), n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))]).astype(np.int64)
        # every run's start is kept beside each sample-th position, so a walk never crosses a separator
        kept = (sa % sample == 0) | (before == 0)
        self.kept, self.positions = Bits(kept), sa[kept]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of a matrix of patterns at once: row ranges [low, high)."""
        m, length = patterns.shape
        return self.search(patterns.reshape(-1), np.arange(m) * length, length)

    def search(self, symbols: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for the patterns of one length that begin at ``starts`` in an array of symbols."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.first[-1])
        for j in range(length - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = symbols[starts[live] + j].astype(np.int64)
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by LF steps to a kept position."""
        out, steps = np.empty(len(rows), np.int64), 0
        at, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            known = self.kept.get(at)
            out[open_[known]] = self.positions[self.kept.rank(at[known])] + steps
            at, open_ = at[~known], open_[~known]
            c = self.wavelet.get(at)
            at = self.first[c] + self.wavelet.rank(c, at)
            steps += 1
        return out
