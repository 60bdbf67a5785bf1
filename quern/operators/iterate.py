"""Loops over plans: lineage is cut by reliable checkpoints, convergence is one number (survey O07, M07, M08, W12, W22)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import use_checkpoints
from .leastsq import least_squares


def repeat(start: DataFrame, step: Callable[[DataFrame], DataFrame], times: int, every: int = 10) -> DataFrame:
    """step applied `times` times, with a checkpoint every so many."""
    use_checkpoints(start.sparkSession)
    state = start
    for i in range(1, times + 1):
        state = step(state)
        if i % every == 0 and i < times:
            state = state.checkpoint()
    return state


def assign(points: DataFrame, centroids: Sequence[Sequence[float]], axes: Sequence[str]) -> DataFrame:
    """Add cluster, the number of the nearest centroid, the first on ties. Centroids are literals: k x d numbers."""
    best, least = F.lit(0), None
    for k, centre in enumerate(centroids):
        d = sum(((F.col(a) - F.lit(float(x))) * (F.col(a) - F.lit(float(x))) for a, x in zip(axes, centre, strict=True)), F.lit(0.0))
        best = F.lit(k) if least is None else F.when(d < least, F.lit(k)).otherwise(best)
        least = d if least is None else F.least(d, least)
    return points.withColumn("cluster", best)


def kmeans(points: DataFrame, start: Sequence[Sequence[float]], axes: Sequence[str], max_steps: int = 20, tolerance: float = 1e-4, empty: str = "keep") -> list[list[float]]:
    """Centroids after at most max_steps, or once the largest shift is below tolerance.

    empty says what a cluster without points becomes: its old centroid ("keep"), "zero" or "nan".
    A step is one partial aggregation; k rows come to the driver.
    """
    centres = [list(map(float, c)) for c in start]
    for _ in range(max_steps):
        found = {r["cluster"]: [r[a] for a in axes] for r in assign(points, centres, axes).groupBy("cluster").agg(*[F.avg(a).alias(a) for a in axes]).collect()}
        blank = {"keep": lambda k: centres[k], "zero": lambda k: [0.0] * len(axes), "nan": lambda k: [float("nan")] * len(axes)}[empty]
        after = [found.get(k, blank(k)) for k in range(len(centres))]
        shift = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for x, y in zip(centres, after, strict=True))
        centres = after
        if shift < tolerance:
            break
    return centres


def sufficient_statistics(df: DataFrame, features: Sequence[str], label: str) -> tuple[list[list[float]], list[float], int]:
    """X^T X, X^T y and the row count with a leading constant feature: one aggregation serves any number of steps."""
    columns = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    y = F.col(label).cast("double")
    d = len(columns)
    terms = [F.sum(columns[i] * columns[j]).alias(f"x{i}_{j}") for i in range(d) for j in range(i, d)]
    row = df.agg(*terms, *[F.sum(columns[i] * y).alias(f"y{i}") for i in range(d)], F.count("*").alias("n")).first()
    return [[row[f"x{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], [row[f"y{i}"] for i in range(d)], row["n"]


def gradient_descent(df: DataFrame, features: Sequence[str], label: str, rate: float = 0.1, steps: int = 100) -> list[float]:
    """Intercept and weights after so many steps on the mean squared error, from zero."""
    xx, xy, n = sufficient_statistics(df, features, label)
    w = [0.0] * len(xy)
    for _ in range(steps):
        slope = [2.0 / n * (sum(a * b for a, b in zip(row, w, strict=True)) - t) for row, t in zip(xx, xy, strict=True)]
        w = [a - rate * g for a, g in zip(w, slope, strict=True)]
    return w


def linear_regression(df: DataFrame, features: Sequence[str], label: str) -> list[float]:
    """Least squares by QR factors, which keep what the normal equations square away."""
    return least_squares(df, features, label)
