"""An FM-index over integer symbols: suffix sorting, wavelet-matrix ranks, sampled positions.

Symbol 0 separates runs.  Each separator sorts as a symbol of its own, so two
suffixes never compare beyond the end of their runs and repeated documents
cost no more sorting rounds than one of them.
"""

from __future__ import annotations

import numpy as np

from tagwatch.llm.wavelet_matrix import WaveletMatrix


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; text ends with a separator."""
    n = len(text)
    gap = text == 0
    rank = np.where(gap, np.cumsum(gap) - 1, text.astype(np.int64) + int(gap.sum()))
    step = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (max(n, int(rank.max()) + 1) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank, step = new, step * 2
        if int(rank[order[-1]]) == n - 1 or step >= n:
            return order


class FMIndex:
    SAMPLE = 8

    def __init__(self, text: np.ndarray):
        """text: symbols, each run followed by a 0."""
        n = len(text)
        order = suffix_array(text)
        self.n, last = n, text[order - 1]  # the symbol before each suffix; order 0 meets the closing separator
        width = max(1, int(text.max()).bit_length())
        self.ranks = WaveletMatrix.build(last.astype(np.int32), width)
        counts = np.bincount(text, minlength=1 << width)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        symbols = np.arange(1 << width)
        self.origin = self.ranks.walk(symbols, np.zeros(len(symbols), np.int64))
        starts = np.concatenate(([True], text[:-1] == 0))
        kept = (order % self.SAMPLE == 0) | starts[order]
        self.kept, self.sampled = np.cumsum(kept), order[kept]
        self.is_kept = kept

    def _before(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.ranks.walk(symbols, i) - self.origin[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows of one length) at once: the interval of each."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[live, column]
            known = symbols < len(self.first) - 1  # a symbol beyond the shard's largest does not occur
            low[live[~known]] = high[live[~known]] = 0
            live, symbols = live[known], symbols[known]
            low[live], high[live] = self._before(symbols, low[live]), self._before(symbols, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: steps back to a sampled one."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.is_kept[rows[live]]
            at = live[done]
            found[at] = self.sampled[self.kept[rows[at]] - 1] + steps[at]
            live = live[~done]
            symbols, ends = self.ranks.access(rows[live])
            rows[live] = self.first[symbols] + ends - self.origin[symbols]
            steps[live] += 1
        return found
