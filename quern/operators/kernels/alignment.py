"""Affine-gap local alignment of many pairs at once: a row of the matrix is one vector step over all of them (survey W15, A20)."""

from __future__ import annotations

import numpy as np

#: Scores of a match and a mismatch, costs of opening and extending a gap.
MATCH, MISMATCH, OPEN, EXTEND = 2, -1, 3, 1
QUERY_PAD, TARGET_PAD = 254, 255


def _padded(texts: list[bytes], pad: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts), default=0)), pad, np.uint8)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def align(queries: list[bytes], targets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, query_end, target_end) of each pair, ends from 1; the first best cell in row-major order, zeros if none is positive.

    E runs down the rows and is a vector step. F runs along a row: since a gap opened from a gap never gains, it is
    a running maximum of opened gaps less the distance. Both are clamped at zero, and opening costs OPEN + EXTEND.
    Padding letters match nothing, so cells beyond a text's end are never better than one before them.
    """
    q, t = _padded(queries, QUERY_PAD), _padded(targets, TARGET_PAD)
    n, width = len(q), t.shape[1]
    score, row_end, column_end = (np.zeros(n, np.int32) for _ in range(3))
    if not width:
        return score, row_end, column_end
    above, e = np.zeros((n, width + 1), np.int32), np.zeros((n, width), np.int32)
    along = np.arange(width, dtype=np.int32) * EXTEND
    for i in range(q.shape[1]):
        e = np.maximum(np.maximum(e - EXTEND, above[:, 1:] - (OPEN + EXTEND)), 0)
        h = np.maximum(np.maximum(above[:, :-1] + np.where(t == q[:, i, None], MATCH, MISMATCH), e), 0)
        opened = np.maximum.accumulate(h + along, axis=1)[:, :-1] - (OPEN + EXTEND)
        h[:, 1:] = np.maximum(h[:, 1:], opened - (along[1:] - EXTEND))
        j = h.argmax(1)
        top = h[np.arange(n), j]
        better = top > score
        score, row_end, column_end = np.where(better, top, score), np.where(better, i + 1, row_end), np.where(better, j + 1, column_end)
        above[:, 1:] = h
    return score, row_end, column_end
