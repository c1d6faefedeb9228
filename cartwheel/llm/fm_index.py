"""A full-text index over words: Burrows-Wheeler transform in a wavelet matrix, searched backward.

The index keeps bit vectors with counters, the number of smaller symbols, and
one bit per suffix that says where ``length`` common words end. The suffix
order is only needed while it is built. Many patterns are searched at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


class Bits:
    """A bit vector with a count before every 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Number of ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit vector per binary digit, highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.digits, self.size, self.levels, self.zeros = max(1, int(size - 1).bit_length()), size, [], []
        for digit in reversed(range(self.digits)):
            bit = (symbols >> digit) & 1
            self.levels.append(Bits(bit))
            ones = bit.astype(bool)
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        every = np.arange(size)
        self.first = self._down(every, np.zeros(size, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for digit, bits, zeros in zip(reversed(range(self.digits)), self.levels, self.zeros):
            ones = bits.ones(at)
            at = np.where((symbol >> digit) & 1 == 1, ones + zeros, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the sorted suffixes, whether each shares its first ``length`` symbols with the one before) by doubling.

    Every suffix must be told apart by its symbols, as marks that occur once do.
    """
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    powers = {1: rank + 1}                  # ranks by that many symbols; zero stands for the end
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:n - width] = powers[width][width:] if width < n else 0
        key = powers[width] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.append(True, key[order[1:]] != key[order[:-1]])
        after = np.empty(n, np.int64)
        after[order] = np.cumsum(fresh)
        width *= 2
        powers[width] = after
        if after[order[-1]] == n and width >= length:
            break
    shared, at = np.ones(n, bool), np.zeros(n, np.int64)
    for step in reversed(range(length.bit_length())):
        if length >> step & 1:
            piece = np.where(order + at < n, powers[1 << step][np.minimum(order + at, n - 1)], 0)
            shared[1:] &= piece[1:] == piece[:-1]
            at += 1 << step
    shared[:1] = False
    return order, shared


class WordIndex:
    """Index of texts given as lists of word numbers 0, 1, ...; each start has a value, the smallest of which a match reports."""

    def __init__(self, texts: Sequence[np.ndarray], values: Sequence[np.ndarray], words: int, length: int):
        self.length, self.words = length, words
        marks = np.arange(len(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1) - 1
        whole = np.empty(int(sizes.sum()) + len(texts), np.int64)
        value = np.full(len(whole), np.iinfo(np.int64).max)
        inside = np.ones(len(whole), bool)
        inside[ends] = False
        whole[ends] = marks                                  # a mark of its own behind every text
        whole[inside] = np.concatenate(texts) + len(texts) if len(texts) else []
        value[inside] = np.concatenate(values) if len(values) else []
        order, shared = suffix_order(whole, length)
        symbol = np.where(inside, whole - len(texts) + 1, 0)
        self.n = len(whole)
        self.tree = WaveletMatrix(symbol[order - 1], words + 1)
        self.smaller = np.append(0, np.cumsum(np.bincount(symbol, minlength=words + 1)))[:-1]
        heads = np.flatnonzero(~shared)                      # classes of suffixes that begin with the same ``length`` words
        self.heads = Bits(~shared)
        self.least = np.minimum.reduceat(value[order], heads) if self.n else value

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with a symbol before those of [low, high)."""
        base = self.smaller[symbol]
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[:len(symbol)], base + both[len(symbol):]

    def matching_statistics(self, patterns: Sequence[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each pattern (longest match at every start, smallest value among the occurrences of its ``length`` words).

        Word numbers from ``words`` on are in no text. Where fewer than
        ``length`` words match the value is the largest number. A pattern is
        read from its end; where no more word can be put before the match, the
        match gives up its last word and is found again.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.concatenate(patterns) if len(patterns) else np.zeros(0, np.int64)
        found, least = np.zeros(len(flat), np.int64), np.full(len(flat), np.iinfo(np.int64).max)
        open_ = np.flatnonzero(sizes > 0)
        begin, stop = starts[open_], starts[open_] + sizes[open_]
        at = stop - 1                                        # the word to put before [at + 1, stop)
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), self.n)
        while len(at):
            known = flat[at] < self.words
            new_low, new_high = self.extend(np.where(known, flat[at] + 1, 0), low, high)
            hit = known & (new_low < new_high)
            low, high = np.where(hit, new_low, 0), np.where(hit, new_high, self.n)
            here = at[hit]
            found[here] = np.maximum(found[here], stop[hit] - here)
            long = hit & (stop - at >= self.length)
            # the class of the interval's first suffix: all that share ``length`` words
            least[at[long]] = self.least[self.heads.ones(low[long] + 1) - 1]
            # a miss: one word less at the end; a word that is nowhere ends all matches
            stop = np.where(hit, stop, np.where(known & (stop - 1 > at), stop - 1, at))
            at = np.where(hit, at - 1, stop - 1)
            going = at >= begin
            begin, stop, at, low, high = begin[going], stop[going], at[going], low[going], high[going]
        return np.split(found, starts[1:]), np.split(least, starts[1:])
