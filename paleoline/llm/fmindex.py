"""An FM-index over sequences of small integers, in numpy: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

_STEP = 8


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t`` (values 1 to ``sigma`` - 1, ended by a single 0) by prefix doubling.

    As many symbols as fit into 62 bits are sorted at once; later rounds sort only the suffixes that still tie.
    """
    n = len(t)
    bits = max(1, int(sigma - 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        if k < n:
            key[: n - k] |= t[k:]
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, np.diff(np.append(first, n)))
    size = np.diff(np.append(first, n))
    open_ = np.repeat(size > 1, size)
    at, k = np.flatnonzero(open_), width
    while len(at):
        own = sa[at]
        nxt = own + k
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        group = rank[own]
        order = np.lexsort((second, group))
        own, group, second = own[order], group[order], second[order]
        sa[at] = own
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[own] = np.repeat(at[first], size)
        at = at[np.repeat(size > 1, size)]
        k *= 2
    return sa


class _Bits:
    """A bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w, off = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << off) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Full-text index of ``t`` (values from 1 on); searches many patterns at once."""

    def __init__(self, t: np.ndarray, sigma: int) -> None:
        t = np.append(np.asarray(t, np.int64), 0)
        self.n = len(t)
        sa = suffix_array(t, sigma)
        bwt = t[sa - 1]
        counts = np.bincount(t, minlength=sigma)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[_Bits, int]] = []
        self.height = max(1, int(sigma - 1).bit_length())
        cur = bwt
        for h in range(self.height - 1, -1, -1):
            b = (cur >> h) & 1 != 0
            self.levels.append((_Bits(b), int(len(cur) - b.sum())))
            cur = np.concatenate([cur[~b], cur[b]])
        marked = sa % _STEP == 0
        self.marked, self.samples = _Bits(marked), sa[marked]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position, down the wavelet matrix."""
        lo, hi = np.zeros_like(i), i.copy()
        for h, (bits, zeros) in zip(range(self.height - 1, -1, -1), self.levels):
            one = (c >> h) & 1 != 0
            l1, h1 = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + l1, lo - l1), np.where(one, zeros + h1, hi - h1)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position of the transform and its occurrences before."""
        c, at, lo = np.zeros_like(i), i.copy(), np.zeros_like(i)
        for bits, zeros in self.levels:
            one = bits.get(at)
            r, l1 = bits.rank(at), bits.rank(lo)
            at, lo = np.where(one, zeros + r, at - r), np.where(one, zeros + l1, lo - l1)
            c = c * 2 + one
        return c, at - lo

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (rows): the interval of suffixes that begin with each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            lo[live], hi[live] = self.before[c] + self.rank(c, lo[live]), self.before[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: back through the text to the next sampled one."""
        at, steps, out = rows.astype(np.int64), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.marked.get(at[todo])
            done = todo[hit]
            out[done] = self.samples[self.marked.rank(at[done])] + steps[done]
            todo = todo[~hit]
            c, r = self.access(at[todo])
            at[todo] = self.before[c] + r
            steps[todo] += 1
        return out
