"""An FM-index over a sequence of integers: wavelet-tree ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(values: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; a suffix that ends is the smaller."""
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        number = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = number
        if number[-1] == n - 1 or step >= n:
            return order
        step *= 2


class WaveletTree:
    """Ranks of symbols in a sequence, a bit level at a time (as a wavelet matrix)."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            zeros = len(values) - int(ones[-1])
            self.levels.append((b, ones, zeros))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for b, ones, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at some places."""
        at, symbol = at.copy(), np.zeros(len(at), np.int64)
        for b, ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            symbol |= one << b
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return symbol


class FMIndex:
    """Counts and locates patterns; symbol 0 separates and is in no pattern."""

    EVERY = 4

    def __init__(self, values: np.ndarray, symbols: int):
        values = np.concatenate((values.astype(np.int64) + 1, [0]))  # an end mark below all
        order = suffix_array(values)
        self.tree = WaveletTree(values[order - 1], max(1, int(symbols + 1).bit_length()))
        counts = np.bincount(values, minlength=symbols + 2)
        self.below = np.concatenate(([0], np.cumsum(counts)))
        self.n = len(values)
        self.sampled = order % self.EVERY == 0
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of patterns (rows) of one length: the ranges of suffixes that start with them."""
        n, length = patterns.shape
        lo, hi = np.zeros(n, np.int64), np.full(n, self.n, np.int64)
        live = np.arange(n)
        for k in range(length - 1, -1, -1):
            c = patterns[live, k].astype(np.int64) + 1
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
            live = live[hi[live] > lo[live]]
            if not len(live):
                break
        gone = np.ones(n, bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: steps back to the nearest sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            there = self.sampled[at[todo]]
            hit = todo[there]
            out[hit] = self.samples[self.sample_no[at[hit]]] + steps[hit]
            todo = todo[~there]
            c = self.tree.access(at[todo])
            at[todo] = self.below[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
        return out
