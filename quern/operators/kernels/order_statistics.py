"""The median of a sliding frame, kept up to date as values come and go."""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np


class SlidingMedian:
    """Two heaps that meet at the median. A value that goes is only noted, and dropped once it stands on top of its heap,
    so both a value that comes and one that goes cost the logarithm of the frame."""

    def __init__(self) -> None:
        self.low: list[float] = []  # negated: the greatest of the lower half is on top
        self.high: list[float] = []
        self.gone: dict[float, dict[float, int]] = {-1.0: defaultdict(int), 1.0: defaultdict(int)}  # of the lower and the upper heap
        self.n_low = self.n_high = 0  # without those that are gone

    def _settle(self) -> None:
        """The lower half has as many as the upper one, or one more; no top is gone."""
        while self.n_low > self.n_high + 1:
            heapq.heappush(self.high, -self._take(self.low, -1.0))
            self.n_low, self.n_high = self.n_low - 1, self.n_high + 1
        while self.n_low < self.n_high:
            heapq.heappush(self.low, -self._take(self.high, 1.0))
            self.n_low, self.n_high = self.n_low + 1, self.n_high - 1
        self._clean(self.low, -1.0)
        self._clean(self.high, 1.0)

    def _clean(self, heap: list[float], sign: float) -> None:
        gone = self.gone[sign]
        while heap and heap[0] in gone:
            value = heapq.heappop(heap)
            gone[value] -= 1
            if not gone[value]:
                del gone[value]

    def _take(self, heap: list[float], sign: float) -> float:
        self._clean(heap, sign)
        return heapq.heappop(heap)

    def add(self, value: float) -> None:
        if self.n_low and value <= -self.low[0]:
            heapq.heappush(self.low, -value)
            self.n_low += 1
        else:
            heapq.heappush(self.high, value)
            self.n_high += 1
        self._settle()

    def remove(self, value: float) -> None:
        if self.n_low and value <= -self.low[0]:
            self.gone[-1.0][-value] += 1
            self.n_low -= 1
        else:
            self.gone[1.0][value] += 1
            self.n_high -= 1
        self._clean(self.low, -1.0)
        self._clean(self.high, 1.0)
        self._settle()

    def median(self) -> float:
        if not self.n_low:
            return float("nan")
        return -self.low[0] if self.n_low > self.n_high else (-self.low[0] + self.high[0]) / 2.0


def sliding_medians(t: np.ndarray, y: np.ndarray, half: float, wanted: np.ndarray) -> np.ndarray:
    """For each wanted row, t ascending: the median of the y, NaN left out, whose t is within half on both sides; NaN of none."""
    out = np.full(len(t), np.nan)
    starts, ends = np.searchsorted(t, t - half, "left"), np.searchsorted(t, t + half, "right")
    frame, first, last = SlidingMedian(), 0, 0
    values = y.tolist()
    for i in np.flatnonzero(wanted):
        for k in range(last, ends[i]):
            if values[k] == values[k]:
                frame.add(values[k])
        last = max(last, ends[i])
        for k in range(first, starts[i]):
            if values[k] == values[k]:
                frame.remove(values[k])
        first = starts[i]
        out[i] = frame.median()
    return out
