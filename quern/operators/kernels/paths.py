"""Paths of local alignments, not only their ends, in memory for a few rows of the matrix (survey M02, M14)."""

from __future__ import annotations

from itertools import groupby

import numpy as np

from .alignment import EXTEND, MATCH, MISMATCH, OPEN

#: Rows that are kept whole while a path is read off them; longer stretches are halved.
ROWS = 64
State = tuple[np.ndarray, np.ndarray]


class Matrix:
    """The scores of one pair, a row at a time: H (width + 1) and E (width + 1), the best that ends in a gap along the query."""

    def __init__(self, query: bytes, target: bytes) -> None:
        self.query, self.target = np.frombuffer(query, np.uint8), np.frombuffer(target, np.uint8)
        self.along = np.arange(len(target), dtype=np.int32) * EXTEND

    def first(self) -> State:
        return np.zeros(len(self.target) + 1, np.int32), np.zeros(len(self.target) + 1, np.int32)

    def after(self, state: State, i: int) -> State:
        """The row of query letter i (from 0) from that before it."""
        above, e = state
        down, h = np.zeros_like(e), np.zeros_like(above)
        down[1:] = np.maximum(np.maximum(e[1:] - EXTEND, above[1:] - (OPEN + EXTEND)), 0)
        inner = np.maximum(np.maximum(above[:-1] + np.where(self.target == self.query[i], MATCH, MISMATCH), down[1:]), 0)
        opened = np.maximum.accumulate(inner + self.along)[:-1] - (OPEN + EXTEND)
        inner[1:] = np.maximum(inner[1:], opened - (self.along[1:] - EXTEND))
        h[1:] = inner
        return h, down

    def back(self, low: int, high: int, state: State, j: int, gap: bool) -> tuple[list[str], int, bool | None]:
        """The steps back from column j of row high to row low, whose state is given: letters in reverse, and the column and
        whether within a gap along the query there; None if the path begins before.

        A longer stretch is halved: the state in its middle is computed without keeping rows, the path is read off the
        second half, and then off the first. So at any time ROWS rows and the states at the halvings are held.
        """
        if high - low > ROWS:
            middle = (low + high) // 2
            there = state
            for i in range(low, middle):
                there = self.after(there, i)
            steps, j, gap_there = self.back(middle, high, there, j, gap)
            if gap_there is None:
                return steps, j, None
            more, j, gap_there = self.back(low, middle, state, j, gap_there)
            return steps + more, j, gap_there
        rows = [state]
        for i in range(low, high):
            rows.append(self.after(rows[-1], i))
        steps, i = [], high
        while i > low:
            (h, e), (above, e_above) = rows[i - low], rows[i - low - 1]
            if gap:
                steps.append("I")
                gap = e[j] != above[j] - (OPEN + EXTEND)
                i -= 1
                continue
            score = h[j]
            if not score:
                return steps, j, None
            same = self.query[i - 1] == self.target[j - 1]
            if score == above[j - 1] + (MATCH if same else MISMATCH):
                steps.append("=" if same else "X")
                i, j = i - 1, j - 1
            elif score == e[j]:
                gap = True
            else:  # a gap along the target, within the row
                length = next(k for k in range(1, j + 1) if h[j - k] - OPEN - k * EXTEND == score)
                steps += ["D"] * length
                j -= length
        return steps, j, gap


def path(query: bytes, target: bytes, query_end: int, target_end: int) -> tuple[int, int, str]:
    """(query_start, target_start, steps) of the alignment that ends behind query_end and target_end letters, starts from 0.

    steps are run lengths: = for equal letters, X for others, I for query letters alone, D for target letters alone.
    Of paths of one score it takes letters before gaps. No alignment: zeros and no steps.
    """
    matrix = Matrix(query, target)
    letters, _, _ = matrix.back(0, query_end, matrix.first(), target_end, False) if query_end else ([], 0, None)
    letters.reverse()
    used = {c: letters.count(c) for c in "=XID"}
    runs = "".join(f"{len(list(run))}{c}" for c, run in groupby(letters))
    return query_end - used["="] - used["X"] - used["I"], target_end - used["="] - used["X"] - used["D"], runs
