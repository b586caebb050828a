"""An FM-index over the words of a block of texts.

The block is one sequence of word ids.  Ids from 1 on are words that a pattern
may contain; 0 stands for every other word and for the ends of texts.  Each 0
counts as a symbol of its own, ordered by position, so suffixes are never
compared beyond it.  The index holds the Burrows-Wheeler transform in a wavelet
matrix (one bit vector with ranks per level), the start of each symbol, and
sampled suffix positions: one in ``sample`` text positions and every position
that follows a 0, so a walk back from a match always meets a sample before it
could cross a 0.
"""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes: a first sort by several symbols, then doubling of the groups still tied.

    Keys carry the position in their low bits, so plain value sorts do the work
    and ties keep the order of positions, which is also the order of the 0s that
    end equal comparisons.
    """
    n = len(seq)
    if n == 0:
        return np.zeros(0, np.int64)
    low = int(n).bit_length()
    width = max(1, int(seq.max()).bit_length())
    depth = max(1, min(8, n, (63 - low) // width))
    key = np.zeros(n, np.int64)
    ended = np.zeros(n, bool)
    for d in range(depth):
        symbol = np.zeros(n, np.int64)
        symbol[: n - d] = seq[d:]
        symbol[ended] = 0
        ended |= symbol == 0
        key = (key << width) | symbol
    packed = np.sort((key << low) | np.arange(n))
    sa = packed & ((1 << low) - 1)
    key = packed >> low
    new = np.r_[True, key[1:] != key[:-1]] | ended[sa]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    step = depth
    while len(tied):
        pos = sa[tied]
        group = rank[pos]
        second = rank[np.minimum(pos + step, n - 1)] + 1
        second[pos + step >= n] = 0
        if 3 * low + 1 <= 63:
            o = np.sort((group << (2 * low + 1)) | (second << low) | np.arange(len(pos))) & ((1 << low) - 1)
        else:
            o = np.lexsort((second, group))
        pos, group, second = pos[o], group[o], second[o]
        sa[tied] = pos
        head = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        size = np.diff(np.r_[head, len(pos)])
        rank[pos] = tied[np.repeat(head, size)]
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return sa


class WaveletMatrix:
    def __init__(self, values: np.ndarray, levels: int) -> None:
        self.n, self.levels = len(values), levels
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        v = values.astype(np.int32)
        for level in range(levels - 1, -1, -1):
            bit = (v >> level) & 1
            ranks = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ranks[1:])
            self.ones.append(ranks)
            self.zeros.append(self.n - int(ranks[-1]))
            set_ = bit.astype(bool)
            v = np.concatenate([v[~set_], v[set_]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position ``at``."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            set_ = ((symbols >> (self.levels - 1 - depth)) & 1).astype(bool)
            a, b = ones[lo].astype(np.int64), ones[hi].astype(np.int64)
            lo = np.where(set_, zeros + a, lo - a)
            hi = np.where(set_, zeros + b, hi - b)
        return hi - lo

    def get(self, at: np.ndarray) -> np.ndarray:
        out, i = np.zeros(len(at), np.int64), at.astype(np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[i].astype(np.int64)
            set_ = ones[i + 1] != ones[i]
            out = out * 2 + set_
            i = np.where(set_, zeros + a, i - a)
        return out


class FMIndex:
    def __init__(self, seq: np.ndarray, symbols: int, sample: int = 8) -> None:
        """``seq``: ids below ``symbols``; it should end with a 0."""
        self.n = n = len(seq)
        sa = suffix_array(seq)
        bwt = seq[sa - 1] if n else seq
        self.starts = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(seq, minlength=symbols), out=self.starts[1:])
        self.wavelet = WaveletMatrix(bwt, max(1, int(symbols - 1).bit_length()))
        kept = (sa % sample == 0) | (bwt == 0)
        self.marks = np.zeros(n + 1, np.int32)
        np.cumsum(kept, out=self.marks[1:])
        self.positions = sa[kept]

    def search(self, steps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of the phrases of ``phrase_steps``: the row ranges that begin with them."""
        first = steps[0][0]
        lo, hi = self.starts[first], self.starts[first + 1]
        for symbol, parent in steps[1:]:
            low, high = lo[parent], hi[parent]
            live = np.flatnonzero(low < high)
            c = symbol[live]
            lo, hi = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
            lo[live] = self.starts[c] + self.wavelet.rank(c, low[live])
            hi[live] = self.starts[c] + self.wavelet.rank(c, high[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows: walk back to a sampled position."""
        out = np.empty(len(rows), np.int64)
        at, walked = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marks[at + 1] != self.marks[at]
            done = todo[hit]
            out[done] = self.positions[self.marks[at[hit]]] + walked[hit]
            todo, at, walked = todo[~hit], at[~hit], walked[~hit] + 1
            if len(todo):
                c = self.wavelet.get(at)
                at = self.starts[c] + self.wavelet.rank(c, at)
        return out


def phrase_steps(phrases: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Plan of a backward search of distinct, equally long phrases (m, k), in their order.

    Step j holds the distinct endings of j + 1 symbols: their first symbol and
    the index of the ending one shorter, so shared endings are searched once.
    """
    m, k = phrases.shape
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    parent = np.zeros(m, np.int64)
    for j in range(k - 1, -1, -1):
        pair = np.stack([parent, phrases[:, j]], axis=1)
        distinct, inverse = np.unique(pair, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        if j == 0:
            steps.append((phrases[:, 0].copy(), parent.copy()))
        else:
            steps.append((distinct[:, 1].copy(), distinct[:, 0].copy()))
        parent = inverse
    if k == 1:
        steps = [(phrases[:, 0].copy(), np.zeros(m, np.int64))]
    return steps
