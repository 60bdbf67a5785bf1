"""Box search on one light curve: all periods, start bins and widths by prefix sums (survey W06, W07, A18)."""

from __future__ import annotations

import numpy as np

#: Fixed values of the search.
BINS, MIN_WIDTH, MAX_WIDTH = 200, 2, 24
PERIODS_AT_ONCE = 64


def period_grid(n: int, low: float = 0.5, high: float = 12.0) -> np.ndarray:
    """n periods, uniform in frequency, the shortest first."""
    return 1.0 / np.linspace(1.0 / low, 1.0 / high, n)


def power_spectrum(t: np.ndarray, y: np.ndarray, dy: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, tuple[float, float, float, float]]:
    """The best signal residue of each period, and (period, t0, duration, depth) of the best one of all.

    The first of equal residues wins, in the order of period, start and width. Blocks of the whole weight or
    of none have no residue; a period without any has -1.
    """
    w = dy**-2.0
    w = w / w.sum()
    x = w * (y - (w * y).sum())
    widths = np.arange(MIN_WIDTH, MAX_WIDTH + 1)
    starts = np.arange(BINS)
    power = np.full(len(periods), -1.0)
    best = (-1.0, 0.0, 0.0, 0.0, 0.0)
    for at in range(0, len(periods), PERIODS_AT_ONCE):
        p = periods[at : at + PERIODS_AT_ONCE]
        phase = np.clip((((t[None, :] / p[:, None]) % 1.0) * BINS).astype(np.int64), 0, BINS - 1)
        flat = (phase + np.arange(len(p))[:, None] * BINS).ravel()
        sums = [np.bincount(flat, np.tile(v, len(p)), len(p) * BINS).reshape(len(p), BINS) for v in (x, w)]
        s, r = (np.concatenate((np.zeros((len(p), 1)), np.cumsum(np.concatenate((v, v[:, :MAX_WIDTH]), 1), 1)), 1) for v in sums)
        ends = starts[:, None] + widths[None, :]
        s, r = s[:, ends] - s[:, starts][:, :, None], r[:, ends] - r[:, starts][:, :, None]
        valid = (r > 1e-15) & (r < 1.0 - 1e-15)
        residue = np.where(valid, s * s / np.where(valid, r * (1.0 - r), 1.0), -1.0).reshape(len(p), -1)
        top = residue.argmax(1)
        power[at : at + len(p)] = residue[np.arange(len(p)), top]
        k = int(power[at : at + len(p)].argmax())
        if power[at + k] > best[0]:
            i, j = np.unravel_index(top[k], (BINS, len(widths)))
            ss, rr, width = s[k, i, j], r[k, i, j], widths[j]
            best = (power[at + k], p[k], (i + width / 2) / BINS * p[k], width / BINS * p[k], -ss / (rr * (1.0 - rr)))
    return power, tuple(map(float, best[1:]))


def significance(power: np.ndarray) -> float:
    median = np.median(power)
    mad = np.median(np.abs(power - median))
    return float((power.max() - median) / (1.4826 * mad)) if mad > 0 else 0.0
