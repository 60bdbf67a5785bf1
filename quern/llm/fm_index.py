"""FM-index over sequences of small integers: a wavelet tree of the Burrows-Wheeler transform, in NumPy."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by prefix doubling.

    Only suffixes that still tie are sorted again, so each round costs what is left undecided.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n + 1, np.int64)  # rank of a suffix: the first place of its group
    rank[n] = -1
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    open_at = np.flatnonzero(np.repeat(sizes > 1, sizes))
    step = 1
    while len(open_at):
        suffix = order[open_at]
        group = rank[suffix]
        key = group * np.int64(n + 2) + rank[np.minimum(suffix + step, n)] + 1
        by = np.argsort(key)
        suffix, key, group = suffix[by], key[by], group[by]
        order[open_at] = suffix
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(key)))
        rank[suffix] = np.repeat(open_at[first], sizes)
        open_at = open_at[np.repeat(sizes > 1, sizes)]
        step *= 2
    return order


class Wavelet:
    """Ranks of symbols in a sequence: a level for each bit, sorted stably by the bits above (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.n = len(symbols)
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.depth)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))).astype(np.uint32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def _down(self, symbol: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        ones = self.ones[level][at].astype(np.int64)
        return np.where((symbol >> (self.depth - 1 - level)) & 1, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place at."""
        low = np.zeros_like(at)
        for level in range(self.depth):
            at, low = self._down(symbol, at, level), self._down(symbol, low, level)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the places, and their ranks there."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.depth):
            ones = self.ones[level]
            bit = (ones[at + 1] - ones[at]).astype(np.int64)
            symbol = symbol << 1 | bit
            at, low = (np.where(bit, self.zeros[level] + ones[x].astype(np.int64), x - ones[x].astype(np.int64)) for x in (at, low))
        return symbol, at - low


class FMIndex:
    """Finds integer patterns in an integer text. Symbols are 1 to n_symbols - 1; 0 is free for separators."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        # -1 ends the text: smaller than all, once
        closed = np.append(text.astype(np.int64) + 1, 0)
        places = suffix_array(closed)
        bwt = closed[places - 1]
        self.bwt = Wavelet(bwt, n_symbols + 1)
        counts = np.bincount(closed, minlength=n_symbols + 2)
        self.before = np.concatenate(([0], np.cumsum(counts)))
        self.size = len(closed)
        sampled = places % sample == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate(([0], np.cumsum(sampled)))
        self.samples = places[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open row intervals of all patterns at once, by backward search. patterns: left-aligned rows, padded."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = patterns[live, lengths[live] - back] + 1
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pattern, place) of every row of the intervals: rows step back through the text to a sampled suffix."""
        counts = np.maximum(high - low, 0)
        pattern = np.repeat(np.arange(len(low)), counts)
        row = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        place, steps = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
        open_at = np.arange(len(row))
        while len(open_at):
            at = row[open_at]
            hit = self.sampled[at]
            done = open_at[hit]
            place[done] = self.samples[self.sample_rank[row[done]]] + steps[done]
            open_at = open_at[~hit]
            symbol, rank = self.bwt.access(row[open_at])
            row[open_at] = self.before[symbol] + rank
            steps[open_at] += 1
        return pattern, place
