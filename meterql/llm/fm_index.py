"""An FM-index over runs of symbols, searched for many phrases at once with NumPy.

Symbols are integers from 1; 0 ends a run. Every end is a symbol of its own,
smaller than all others and ordered by place, so suffixes are all different
and the last-to-first mapping is exact.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class WaveletMatrix:
    """Rank of a symbol before a position, for arrays of both; one bit vector per level."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            ones = (symbols >> shift & 1).astype(bool)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            zeros = len(symbols) - int(before[-1])
            self.levels.append((shift, before, zeros))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(at), at
        for shift, before, zeros in self.levels:
            one = (symbol >> shift & 1).astype(bool)
            s, e = before[start], before[end]
            start, end = np.where(one, zeros + s, start - s), np.where(one, zeros + e, end - e)
        return end - start


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling; a run's end is where its suffixes stop."""
    n, ends = len(symbols), symbols == 0
    n_ends = int(ends.sum())
    rank = symbols.astype(np.int64) + n_ends
    rank[ends] = np.arange(n_ends)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1 if step < n else 0
        follow[rank < n_ends] = 0  # ends are told apart already
        keys = rank * (int(rank.max()) + 2 if n else 1) + follow if n else rank
        order = np.argsort(keys, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = keys[order[1:]] != keys[order[:-1]]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh) - 1
        if n == 0 or int(new[order[-1]]) == n - 1:
            return order
        rank, step = new, 2 * step


class FMIndex:
    """symbols: int array; each run of symbols from 1 ends with one 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        self.n = len(symbols)
        order = suffix_array(symbols)
        previous = np.where(order > 0, symbols[order - 1], 0).astype(np.int32)
        self.last = previous
        self.tree = WaveletMatrix(previous, max(1, int(n_symbols).bit_length()))
        counts = np.bincount(symbols, minlength=n_symbols + 1)
        self.below = np.concatenate([[0], np.cumsum(counts)])[: n_symbols + 1].astype(np.int64)
        # The start of each run is sampled too: nothing in front of it belongs to the run.
        self.kept = (order % sample == 0) | (previous == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(self.kept)]).astype(np.int64)
        self.places = order[self.kept]

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.below[symbol] + self.tree.rank(symbol, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of a 2-D array: (row, first, end) of those that occur."""
        rows = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[rows, k].astype(np.int64)
            low, high = self._step(symbol, low), self._step(symbol, high)
            found = low < high
            rows, low, high = rows[found], low[found], high[found]
            if not len(rows):
                break
        return rows, low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: step back to the next sampled one."""
        out, at = np.zeros(len(at), np.int64), at.copy()
        left, steps = np.arange(len(at)), 0
        while len(left):
            now = at[left]
            done = self.kept[now]
            out[left[done]] = self.places[self.kept_before[now[done]]] + steps
            left, now = left[~done], now[~done]
            at[left] = self._step(self.last[now].astype(np.int64), now)
            steps += 1
        return out

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of every occurrence of every row of a 2-D array."""
        rows, low, high = self.search(phrases)
        many = high - low
        first = np.repeat(low, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(rows, many), self.locate(first)
