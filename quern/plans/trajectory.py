"""Analyses of a trajectory (frame, atom, x, y, z) with a topology (survey M05, M14, A12-A13, A31-A32, V05)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_zero
from ..operators import spatial
from ..operators.spatial import AXES

R_MAX, R_BINS = 1.2, 240


def _edges(r_max: float, bins: int) -> list[float]:
    step = r_max / bins
    return [*[i * step for i in range(bins)], r_max]


def pair_distribution(traj: DataFrame, topology: DataFrame, box: Sequence[float], r_max: float = R_MAX, bins: int = R_BINS) -> DataFrame:
    """(bin, r, hist, g) of atoms of type 1: pair counts over all frames, over those of an ideal gas."""
    oxygens = traj.join(topology.where("type = 1").select("atom"), "atom").withColumnRenamed("atom", "id")
    hist = spatial.pair_histogram(oxygens, box, _edges(r_max, bins), ("frame",))
    n = oxygens.groupBy("frame").count().agg(F.max("count").alias("atoms"), F.count("*").alias("frames"))
    step = r_max / bins
    low, high = F.col("bin") * step, (F.col("bin") + 1) * step
    shell = F.lit(4.0 / 3.0 * math.pi) * (high * high * high - low * low * low)
    ideal = shell * (F.col("atoms") * (F.col("atoms") - 1) / 2.0) / F.lit(float(box[0] * box[1] * box[2])) * F.col("frames")
    joined = hist.crossJoin(F.broadcast(n))  # one row of totals
    return joined.select("bin", ((F.col("bin") + 0.5) * step).alias("r"), F.col("n").alias("hist"), nan_to_zero(F.try_divide(F.col("n").cast("double"), ideal)).alias("g"))


def bond_counts(traj: DataFrame, roles: DataFrame, box: Sequence[float]) -> DataFrame:
    """(frame, hbonds), zeros included."""
    atoms = traj.withColumnRenamed("atom", "id")
    found = spatial.hydrogen_bonds(atoms, roles, box).groupBy("frame").agg(F.count("*").alias("hbonds"))
    return traj.select("frame").distinct().join(found, "frame", "left").select("frame", F.coalesce("hbonds", F.lit(0)).alias("hbonds"))


def native_contacts(traj: DataFrame, topology: DataFrame, box: Sequence[float], cutoff: float = 0.8, native_frame: int = 0) -> DataFrame:
    """(frame, q) of atoms of type 0."""
    chain = traj.join(topology.where("type = 0").select("atom"), "atom").withColumnRenamed("atom", "id")
    found = spatial.contacts(chain, box, cutoff, ("frame",))
    return spatial.native_fraction(found, traj, "frame", native_frame)


def first_peak(distribution: DataFrame) -> DataFrame:
    return distribution.agg(F.max_by("r", F.struct("g", -F.col("bin"))).alias("r"), F.max("g").alias("g"))


def fluctuation(traj: DataFrame, by: str = "atom") -> DataFrame:
    """(atom, rmsf): the root mean square distance of each atom from its mean place over all frames."""
    mean = [F.avg(c).alias(f"m{c}") for c in AXES]
    # of x: E[(x - m)^2] by the variance, one partial aggregation
    return traj.select(by, *[F.col(c).cast("double").alias(c) for c in AXES]).groupBy(by).agg(F.sqrt(sum((F.var_pop(c) for c in AXES), F.lit(0.0))).alias("rmsf"), *mean).select(by, "rmsf")


def deviation(traj: DataFrame, atoms: DataFrame, reference: int = 0) -> DataFrame:
    """(frame, rmsd) of the atoms (atom) from the reference frame after the best shift and turn of each frame (Kabsch).

    The reference goes to each frame by atom; a frame's covariance is nine sums, so frames are never held whole: only the
    nine numbers and the spreads are solved, a frame a row.
    """
    at = traj.join(atoms.select("atom").distinct(), "atom").select("frame", "atom", *[F.col(c).cast("double").alias(c) for c in AXES])
    fixed = at.where(F.col("frame") == reference).select("atom", *[F.col(c).alias(f"r{c}") for c in AXES])
    sums = [F.covar_pop(a, f"r{b}").alias(f"c{a}{b}") for a in AXES for b in AXES]
    spread = sum((F.var_pop(c) + F.var_pop(f"r{c}") for c in AXES), F.lit(0.0))
    rows = at.join(fixed, "atom").groupBy("frame").agg(spread.alias("spread"), *sums)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            c = part[[f"c{a}{b}" for a in AXES for b in AXES]].to_numpy(np.float64).reshape(-1, 3, 3)
            sizes = np.linalg.svd(c, compute_uv=False)
            best = sizes[:, 0] + sizes[:, 1] + np.sign(np.linalg.det(c)) * sizes[:, 2]
            yield pd.DataFrame({"frame": part["frame"], "rmsd": np.sqrt(np.maximum(part["spread"].to_numpy() - 2 * best, 0.0))})

    return rows.mapInPandas(solve, f"frame {traj.schema['frame'].dataType.simpleString()}, rmsd double")


def surface(atoms: DataFrame, box: Sequence[float], probe: float = 0.14, points: int = 60) -> DataFrame:
    """(id, area): the surface of each atom (id, x, y, z, radius) that a probe can touch, by points on spheres.

    Points are spread evenly by the golden angle; one is covered if another atom's sphere reaches over it. They meet the atoms
    near them by cells.
    """
    k = F.col("k").cast("double") + 0.5
    height = F.lit(1.0) - 2.0 * k / points
    ring, turn = F.sqrt(F.lit(1.0) - height * height), math.pi * (3.0 - math.sqrt(5.0)) * k
    spots = atoms.select("id", *AXES, (F.col("radius") + probe).alias("reach"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    on = {"x": ring * F.cos(turn), "y": ring * F.sin(turn), "z": height}
    spots = spots.select(F.struct("id", "k").alias("spot"), F.col("id").alias("owner"), "reach", *[(F.col(c).cast("double") + F.col("reach") * on[c]).alias(c) for c in AXES])
    most = (atoms.agg(F.max("radius")).first()[0] or 0.0) + probe
    others = atoms.select(F.struct("id", F.lit(-1).alias("k")).alias("spot"), *AXES)
    reaches = atoms.select(F.col("id").alias("other"), (F.col("radius") + probe).alias("r"))
    met = spatial.cell_join(spots, others, box, most, (), "spot").select(F.col("a").alias("spot"), F.col("b.id").alias("other"), "r2").where("other <> spot.id")
    covered = met.join(reaches, "other").where("r2 < r * r * (1 - 1e-12)").select("spot").distinct()
    left = spots.join(covered, "spot", "left_anti").groupBy("owner").agg(F.count("*").alias("n"))
    area = 4.0 * math.pi / points * (F.col("radius") + probe) * (F.col("radius") + probe) * F.coalesce("n", F.lit(0))
    return atoms.select("id", "radius").join(left.withColumnRenamed("owner", "id"), "id", "left").select("id", area.alias("area"))
