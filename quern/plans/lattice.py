"""Lattice-Boltzmann steps as plans over a table of cells, and sweeps of small grids (survey M04, P32-P36, W13, W16, V04)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import DIRECTIONS, OPPOSITE, equilibrium, moments
from ..operators.iterate import repeat
from ..operators.kernels import lattice as kernel

POPULATIONS = [f"f{i}" for i in range(9)]


def solid_mask(case: str, nx: int, ny: int) -> tuple[Column, Column]:
    """(solid, lid) as functions of the coordinates: masks are recomputed, never joined."""
    x, y = F.col("x"), F.col("y")
    if case == "cylinder":
        r = max(3, ny // 9)
        return ((x - nx // 5) * (x - nx // 5) + (y - ny // 2) * (y - ny // 2) < r * r) | (y == 0) | (y == ny - 1), F.lit(False)
    return (x == 0) | (x == nx - 1) | (y == 0) | (y == ny - 1), y == ny - 1


def start(spark: SparkSession, case: str, nx: int, ny: int, u0: float = 0.05) -> DataFrame:
    cells = spark.range(nx * ny).select(F.expr(f"id div {ny}").alias("x"), (F.col("id") % ny).alias("y"))
    solid, _ = solid_mask(case, nx, ny)
    ux = F.lit(u0) * (F.lit(1.0) + F.lit(1e-4) * F.sin(F.lit(2 * math.pi) * F.col("y") / (ny - 1))) if case == "cylinder" else F.lit(0.0)
    at_rest = cells.withColumn("ux", F.when(solid, 0.0).otherwise(ux))
    return at_rest.select("x", "y", *[e.alias(n) for e, n in zip(equilibrium(F.lit(1.0), F.col("ux"), F.lit(0.0)), POPULATIONS, strict=True)])


def step(cells: DataFrame, case: str, nx: int, ny: int, omega: float, u0: float = 0.05) -> DataFrame:
    """Moments, boundary values, collision, bounce-back and streaming with outflow: one exchange a step."""
    solid, lid = solid_mask(case, nx, ny)
    driven = F.col("x") == 0 if case == "cylinder" else lid
    rho, ux, uy = moments([F.col(n) for n in POPULATIONS])
    held = cells.withColumns({"rho": rho, "ux": ux, "uy": uy, "bounce": solid & ~lid, "driven": driven})
    held = held.withColumns({"rho": F.when(F.col("driven"), 1.0).otherwise(F.col("rho")), "ux": F.when(F.col("bounce"), 0.0).when(F.col("driven"), u0).otherwise(F.col("ux")), "uy": F.when(F.col("bounce") | F.col("driven"), 0.0).otherwise(F.col("uy"))})
    held = held.withColumns({f"e{i}": e for i, e in enumerate(equilibrium(F.col("rho"), F.col("ux"), F.col("uy")))})
    held = held.withColumns({n: F.when(F.col("driven"), F.col(f"e{i}")).otherwise(F.col(n)) for i, n in enumerate(POPULATIONS)})
    sent = []
    for i, (cx, cy) in enumerate(DIRECTIONS):
        value = F.when(F.col("bounce"), F.col(f"f{OPPOSITE[i]}")).otherwise(F.col(f"f{i}") - F.lit(omega) * (F.col(f"f{i}") - F.col(f"e{i}")))
        x, y = F.pmod(F.col("x") + cx, F.lit(nx)), F.pmod(F.col("y") + cy, F.lit(ny))
        one = lambda x, value=value, y=y, i=i: F.struct(x.alias("x"), y.alias("y"), F.lit(i).alias("i"), value.alias("v"))
        if case == "cylinder" and i in kernel.OUTFLOW:
            # the last column copies what the column before it receives, instead of receiving itself
            sent += [F.when(x != nx - 1, one(x)), F.when(x == nx - 2, one(F.lit(nx - 1).cast("long")))]
        else:
            sent.append(one(x))
    moved = held.select(F.explode(F.array(*sent)).alias("m")).where("m is not null").select("m.*")
    return moved.groupBy("x", "y").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(n) for i, n in enumerate(POPULATIONS)])


def run(spark: SparkSession, case: str, nx: int, ny: int, steps: int, reynolds: float, u0: float = 0.05) -> DataFrame:
    """(x, y, ux, uy, rho, solid) after so many steps, for grids beyond one machine's memory."""
    _, _, length = kernel.masks(case, max(nx, 10), ny)
    omega = kernel.relaxation(length, reynolds, u0)
    cells = repeat(start(spark, case, nx, ny, u0), lambda c: step(c, case, nx, ny, omega, u0), steps)
    solid, _ = solid_mask(case, nx, ny)
    rho, ux, uy = moments([F.col(n) for n in POPULATIONS])
    return cells.select("x", "y", F.when(solid, 0.0).otherwise(ux).alias("ux"), F.when(solid, 0.0).otherwise(uy).alias("uy"), rho.alias("rho"), solid.alias("solid"))


def sweep(cases: DataFrame) -> DataFrame:
    """Small grids, one a row of (name, case, nx, ny, steps, reynolds, sample_every): mass drift, top speed, wall speed and Strouhal number."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.itertuples():
                found = kernel.simulate(r.case, r.nx, r.ny, r.steps, r.reynolds, sample_every=r.sample_every)
                length = kernel.masks(r.case, r.nx, r.ny)[2]
                wall = np.abs(found["ux"][found["solid"]]).max()
                out.append((r.name, float(found["rho"].mean() - 1.0), float(np.abs(found["ux"]).max()), float(wall), kernel.strouhal(found["probe"], length, 0.05)))
            yield pd.DataFrame(out, columns=["name", "mass_drift", "top_speed", "wall_speed", "strouhal"])

    found = cases.mapInPandas(solve, "name string, mass_drift double, top_speed double, wall_speed double, strouhal double")
    return found.withColumn("strouhal", F.coalesce("strouhal", F.lit(float("nan"))))  # pandas gives NaN as null


def spectral_peaks(signals: DataFrame, by: str) -> DataFrame:
    """(by, frequency, amplitude) of the strongest tone of each evenly sampled signal (by, t, v), a signal a group."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        t, v = rows["t"].to_numpy(np.float64), rows["v"].to_numpy(np.float64)
        return pd.DataFrame([(key[0], *kernel.peak(v - v.mean(), t[1] - t[0]))], columns=[by, "frequency", "amplitude"])

    return signals.groupBy(by).applyInPandas(one, f"{by} {signals.schema[by].dataType.simpleString()}, frequency double, amplitude double")
