"""An FM-index over word numbers: suffix array, wavelet matrix, sampled positions (numpy)."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (non-negative integers) in order, by prefix doubling.

    The first sort looks at as many symbols as fit in a 63-bit key; later rounds sort only
    suffixes that are not told apart yet, by twice as many symbols each time.
    """
    n = len(s)
    bits = max(1, int(s.max(initial=0) + 1).bit_length())
    reach = max(1, 63 // bits)
    key = np.zeros(n, dtype=np.int64)
    for j in range(reach):
        key <<= bits
        if j < n:
            key[: n - j] |= s[j:] + 1
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.ones(n, dtype=bool)  # whether a group of equal prefixes starts at this row
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, dtype=np.int64)  # first row of a suffix's group
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        rows = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(rows):
            return sa
        at = sa[rows]
        after = at + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[at] * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        sa[rows] = at
        first = np.ones(len(rows), dtype=bool)
        first[1:] = pair[1:] != pair[:-1]
        new[rows] = first
        rank[at] = np.maximum.accumulate(np.where(first, rows, 0))
        reach *= 2


class Wavelet:
    """A wavelet matrix: how often a symbol comes before a position, for many of both at once."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = range(max(1, int(size - 1).bit_length()) - 1, -1, -1)
        self.zeros: list[np.ndarray] = []  # zeros before each position, level by level
        for level in self.levels:
            ones = ((symbols >> level) & 1).astype(bool)
            zeros = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(~ones, out=zeros[1:])
            self.zeros.append(zeros)
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.first = self.down(np.arange(size), np.zeros(size, dtype=np.int64))

    def down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            before = zeros[at]
            at = np.where((symbols >> level) & 1, zeros[-1] + at - before, before)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.down(symbols, at) - self.first[symbols]


class Index:
    """Index of texts of symbols 1.. given one after the other, each followed by a 0.

    ``ends`` are the places of the zeros. Zeros differ from each other, so no match and no
    comparison goes over the end of a text.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, size: int, step: int = 16):
        unique = symbols + len(ends) - 1
        unique[ends] = np.arange(len(ends))
        self.sa_len = len(symbols)
        sa = suffix_array(unique)
        self.bwt = symbols[sa - 1]
        self.wavelet = Wavelet(self.bwt, size)
        counts = np.bincount(symbols, minlength=size)
        self.less = np.cumsum(counts) - counts
        # Sampled positions: every step-th one and the first of each text.
        kept = sa % step == 0
        starts = np.zeros(len(symbols), dtype=bool)
        starts[0] = True
        starts[ends[:-1] + 1] = True
        kept |= starts[sa]
        self.kept, self.kept_before = kept, np.cumsum(kept) - kept
        self.sampled = sa[kept]

    def back(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One step of backward search: where rows that follow ``symbols`` start."""
        return self.less[symbols] + self.wavelet.rank(symbols, rows)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur (their numbers) and their ranges of rows.

        ``phrases`` is a matrix, one phrase per line, filled up on the left by -1.
        """
        own = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.sa_len, dtype=np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[own, j]
            more = c >= 0
            low[more], high[more] = self.back(c[more], low[more]), self.back(c[more], high[more])
            alive = low < high
            own, low, high = own[alive], low[alive], high[alive]
        return own, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows, by stepping back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            found = self.kept[rows]
            out[open_[found]] = self.sampled[self.kept_before[rows[found]]] + steps
            open_, rows = open_[~found], rows[~found]
            rows = self.back(self.bwt[rows], rows)
            steps += 1
        return out
