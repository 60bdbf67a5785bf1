"""Climate indices of one cell from its (year, day) matrix (survey A14-A17, W03-W05)."""

from __future__ import annotations

import numpy as np

DAYS = 365


def circular_percentile(values: np.ndarray, p: float, reach: int = 2) -> np.ndarray:
    """The percentile of each day of the year over all years and the days within reach, the year wrapping round."""
    pooled = np.concatenate([np.roll(values, o, axis=1) for o in range(-reach, reach + 1)])
    at = p * (len(pooled) - 1)
    low = int(at)
    part = np.partition(pooled, (low, min(low + 1, len(pooled) - 1)), axis=0)
    a, b = part[low], part[min(low + 1, len(pooled) - 1)]
    return a + (b - a) * (at - low)


def run_lengths(flags: np.ndarray) -> np.ndarray:
    """For each cell of a boolean matrix the length of the run of its row that ends there, else 0."""
    ends = np.zeros(flags.shape, np.int64)
    running = np.zeros(len(flags), np.int64)
    last = flags.shape[1] - 1
    for day in range(flags.shape[1]):
        running = (running + 1) * flags[:, day]
        over = running > 0 if day == last else (running > 0) & ~flags[:, day + 1]
        ends[over, day] = running[over]
    return ends


def indices(tasmax: np.ndarray | None, pr: np.ndarray | None, wanted: tuple[str, ...], reference_years: int) -> dict[str, np.ndarray]:
    """The wanted indices of every year."""
    out = {}
    if "tx90p" in wanted:
        out["tx90p"] = (tasmax > circular_percentile(tasmax[:reference_years], 0.9)).sum(1) / DAYS
    if "hwdi" in wanted:
        ends = run_lengths(tasmax > tasmax[:reference_years].mean(0) + 5.0)
        out["hwdi"] = np.where(ends >= 6, ends, 0).sum(1).astype(float)
    if "gdd" in wanted:
        out["gdd"] = np.maximum(tasmax - 283.15, 0.0).sum(1)
    if "cdd" in wanted:
        out["cdd"] = run_lengths(pr < 1.0).max(1).astype(float)
    return out
