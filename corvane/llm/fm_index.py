"""An FM-index over sequences of symbols, searched for many patterns at once.

Symbols are 1..sigma-1; 0 ends a sequence. The last column of the sorted suffixes is kept in a wavelet matrix
(one bit vector with block ranks per bit of a symbol), and the suffix array only at sequence starts and at every
``sample``-th position. Sequences end with 0s that sort by position, which makes all suffixes distinct, so that
steps to the previous symbol are exact; a walk never crosses a sequence start, since that is sampled.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffix positions of a text whose 0s are taken as distinct and rising, by prefix doubling of tied suffixes."""
    n = len(text)
    ends = text == 0
    key = text.astype(np.int64) + int(ends.sum())
    key[ends] = np.arange(int(ends.sum()))
    order = np.argsort(key, kind="stable")
    k = 1
    sorted_key = key[order]
    starts = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    while True:
        first = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        rank = np.empty(n, np.int64)
        rank[order] = first
        tied = np.flatnonzero(~starts | np.append(~starts[1:], False))
        if not len(tied):
            return order
        at = order[tied]
        # a tied suffix holds no 0 in its first k symbols, so position k after it is within the text
        pair = rank[at] * (n + 1) + rank[at + k]
        by = np.argsort(pair, kind="stable")
        order[tied] = at[by]
        pair = pair[by]
        starts[tied] = np.concatenate([[True], pair[1:] != pair[:-1]])
        k *= 2


class Bits:
    """A bit vector with ranks in blocks of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & mask)


class Wavelet:
    """A wavelet matrix: symbols and their ranks at many places at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol comes before each place."""
        base = np.zeros_like(i)
        for shift, bits, zeros in self.levels:
            one = symbol >> shift & 1 == 1
            ri, rb = bits.rank(i), bits.rank(base)
            i, base = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rb, base - rb)
        return i - base

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it comes before it."""
        base, out = np.zeros_like(i), np.zeros_like(i)
        for _, bits, zeros in self.levels:
            one = bits[i]
            ri, rb = bits.rank(i), bits.rank(base)
            out = out << 1 | one
            i, base = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rb, base - rb)
        return out, i - base


class FMIndex:
    """Index of a text of sequences that each end with 0."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        order = suffix_array(text)
        last = text[order - 1]  # before position 0 stands the final 0
        self.n, self.less = len(text), np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.column = Wavelet(last.astype(np.int64), sigma)
        sampled = (last == 0) | (order % sample == 0)
        self.sampled, self.places = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of suffixes that begin with each pattern; patterns are padded at the end."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c = patterns[on, k].astype(np.int64)
            lo[on], hi[on] = self.less[c] + self.column.rank(c, lo[on]), self.less[c] + self.column.rank(c, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern number, text position) of every occurrence in the row ranges."""
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        row = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        place, steps = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        walking = np.arange(len(row))
        while len(walking):
            here = row[walking]
            done = self.sampled[here]
            at = walking[done]
            place[at] = self.places[self.sampled.rank(row[at])] + steps[at]
            walking = walking[~done]
            c, rank = self.column.symbol_and_rank(row[walking])
            row[walking] = self.less[c] + rank
            steps[walking] += 1
        return which, place
