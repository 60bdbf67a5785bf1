"""Stencils on grids (r, c, v): neighbours come by shifted keys, so no partition border is a domain border (survey W10-W14, W23, J26, R07)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gather(grid: DataFrame, weights: Mapping[tuple[int, int], float], shape: tuple[int, int] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., r, c, v): the weighted sum of neighbours at the offsets; outside cells count 0, or wrap round if shape is given.

    Each cell sends its weighted value to the cells it is a neighbour of, and the sums are one aggregation
    by target: a single exchange whatever the number of offsets.
    """
    targets = F.explode(F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float(w)).alias("w")) for (dr, dc), w in weights.items()]))
    sent = grid.select(*by, "r", "c", "v", targets.alias("o"))
    r, c = F.col("r") + F.col("o.dr"), F.col("c") + F.col("o.dc")
    if shape:
        r, c = F.pmod(r, F.lit(shape[0])), F.pmod(c, F.lit(shape[1]))
    sums = sent.select(*by, r.alias("r"), c.alias("c"), (F.col("v") * F.col("o.w")).alias("x")).groupBy(*by, "r", "c").agg(F.sum("x").alias("v"))
    return sums if shape else sums.join(grid.select(*by, "r", "c"), [*by, "r", "c"], "left_semi")


LAPLACE = {(0, 0): -4.0, (1, 0): 1.0, (-1, 0): 1.0, (0, 1): 1.0, (0, -1): 1.0}


def laplacian(grid: DataFrame, boundary: float = 0.0, shape: tuple[int, int] | None = None) -> DataFrame:
    """Five-point Laplacian with a constant value beyond the edges of the grid of that shape."""
    inner = gather(grid, LAPLACE)
    if not boundary:
        return inner
    if not shape:
        raise ValueError("a boundary other than 0 needs the grid's shape")
    outside = sum((F.when(F.col(k) == edge, 1).otherwise(0) for k, n in zip(("r", "c"), shape, strict=True) for edge in (0, n - 1)), F.lit(0))
    return inner.withColumn("v", F.col("v") + outside * F.lit(boundary))


def roll(grid: DataFrame, dr: int, dc: int, shape: tuple[int, int]) -> DataFrame:
    """Periodic shift along both axes: a projection."""
    return grid.withColumn("r", F.pmod(F.col("r") + dr, F.lit(shape[0]))).withColumn("c", F.pmod(F.col("c") + dc, F.lit(shape[1])))


def smooth(grid: DataFrame, shape: tuple[int, int], times: int = 3) -> DataFrame:
    """Mean of a cell and its four periodic neighbours, repeated."""
    for _ in range(times):
        grid = gather(grid, {k: 0.2 for k in LAPLACE}, shape)
    return grid


def heat_step(grid: DataFrame, dt_alpha: float, boundary: float, shape: tuple[int, int]) -> DataFrame:
    """One explicit Euler step of the heat equation: u + dt alpha laplacian(u)."""
    change = laplacian(grid, boundary, shape).withColumnRenamed("v", "l")
    return grid.join(change, ["r", "c"]).select("r", "c", (F.col("v") + F.lit(dt_alpha) * F.col("l")).alias("v"))


def profile(grid: DataFrame, axis: str, at: int) -> DataFrame:
    """The cells of one row or column."""
    return grid.where(F.col(axis) == at)
