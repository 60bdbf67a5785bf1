"""Building a molecular system and moving it: chains, sites for waters, their hydrogens, relaxation (survey S29, W19-W21)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import minimum_image, uniform
from ..operators.iterate import repeat
from ..operators.spatial import AXES, close_pairs, nearest_partner, without_clashes

ANGLE = math.radians(104.5)


def directions(rows: DataFrame, seed: int, *keys: Column) -> DataFrame:
    """Add sx, sy, sz, a unit vector from hashed numbers."""
    v = [uniform(seed + k, *keys) - 0.5 for k in range(3)]
    length = F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    return rows.withColumns({f"s{c}": x / F.greatest(length, F.lit(1e-12)) for c, x in zip(AXES, v, strict=True)})


def random_walk(steps: DataFrame, centre: Sequence[float], bond: float, pull: float) -> DataFrame:
    """(chain, i, x, y, z) of steps (chain, i, sx, sy, sz): each goes a bond on, and is then drawn back to the centre by the share `pull`.

    A chain is a recurrence, hence a group; chains are built in parallel.
    """

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        c, at = np.array(centre), np.empty((len(rows), 3))
        p = c.copy()
        for k, s in enumerate(rows[[f"s{a}" for a in AXES]].to_numpy()):
            p = p + bond * s
            p = p + pull * (c - p)
            at[k] = p
        return pd.DataFrame({"chain": key[0], "i": rows["i"].to_numpy(), **{a: at[:, k] for k, a in enumerate(AXES)}})

    return steps.select("chain", "i", *[f"s{a}" for a in AXES]).groupBy("chain").applyInPandas(walk, "chain long, i long, x double, y double, z double")


def sites(spark: SparkSession, side: int, box: float, jitter: float, seed: int) -> DataFrame:
    """(id, x, y, z) of a cubic lattice of side^3 sites, each moved by at most half of jitter along each axis."""
    at = (F.col("id") % side, F.floor(F.col("id") / side) % side, F.floor(F.col("id") / (side * side)))
    return spark.range(side**3).select("id", *[((i + 0.5) * (box / side) + jitter * (uniform(seed + k, F.col("id")) - 0.5)).alias(c) for k, (c, i) in enumerate(zip(AXES, at, strict=True))])


def free_sites(lattice: DataFrame, taken: DataFrame, box: Sequence[float], n: int, clash: float, seed: int) -> DataFrame:
    """n sites, drawn by a hash, of those that are no nearer than clash to what is there already."""
    return without_clashes(lattice, taken, box, clash).orderBy(uniform(seed, F.col("id")), "id").limit(n)


def oriented(oxygens: DataFrame, box: Sequence[float], cutoff: float, arm: float, seed: int, angle: float = ANGLE) -> DataFrame:
    """(id, h, x, y, z): the first hydrogen (h = 1) of each oxygen (id, x, y, z) points at the nearest other one within cutoff, or
    along a hashed direction where there is none; the second stands at `angle` to it, on a hashed side."""
    near = nearest_partner(oxygens, box, cutoff).select(F.col("a").alias("id"), F.col("partner").alias("p"))
    other = oxygens.select(F.col("id").alias("p"), *[F.col(c).alias(f"p{c}") for c in AXES])
    both = oxygens.join(near, "id", "left").join(other, "p", "left")
    both = directions(both, seed, F.col("id")).withColumnsRenamed({f"s{c}": f"f{c}" for c in AXES})
    both = directions(both, seed + 3, F.col("id"))
    # components of the way to the partner, in the periodic box
    way = {c: F.when(F.col("p").isNull(), F.col(f"f{c}")).otherwise(minimum_image(F.col(f"p{c}") - F.col(c), box[i])) for i, c in enumerate(AXES)}
    both = both.withColumns({f"w{c}": v for c, v in way.items()})
    both = both.withColumn("wn", F.greatest(F.sqrt(_dot("w", "w")), F.lit(1e-12))).withColumns({f"u{c}": F.col(f"w{c}") / F.col("wn") for c in AXES})
    both = both.withColumn("along", _dot("s", "u")).withColumns({f"q{c}": F.col(f"s{c}") - F.col("along") * F.col(f"u{c}") for c in AXES})
    both = both.withColumn("qn", F.greatest(F.sqrt(_dot("q", "q")), F.lit(1e-12)))
    second = lambda c: math.cos(angle) * F.col(f"u{c}") + math.sin(angle) * F.col(f"q{c}") / F.col("qn")
    at = lambda c, i, v: F.pmod(F.col(c) + arm * v, F.lit(box[i])).alias(c)
    first = F.struct(F.lit(1).alias("h"), *[at(c, i, F.col(f"u{c}")) for i, c in enumerate(AXES)])
    return both.select("id", F.explode(F.array(first, F.struct(F.lit(2).alias("h"), *[at(c, i, second(c)) for i, c in enumerate(AXES)]))).alias("a")).select("id", "a.*")


def _dot(a: str, b: str) -> Column:
    return sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in AXES), F.lit(0.0))


def relax_step(atoms: DataFrame, bonds: DataFrame, box: Sequence[float], near: float, repel: float, stiff: float, step: float) -> DataFrame:
    """Atoms (id, x, y, z) one overdamped step on: pairs nearer than `near` push apart, bonds (a, b, length) draw to their lengths.

    Pairs come by cells; both kinds of force are rows to be added up by atom, so a step is a cell join, a join of bonds and one
    aggregation.
    """
    at = atoms.select("id", *AXES)
    ends = lambda k: at.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}{c}") for c in AXES])
    close = close_pairs(at, box, near).where("r2 > 1e-18").select("a", "b", F.lit(None).cast("double").alias("length"))
    pairs = close.unionByName(bonds.select("a", "b", "length")).join(ends("a"), "a").join(ends("b"), "b")
    pairs = pairs.withColumns({f"d{c}": minimum_image(F.col(f"a{c}") - F.col(f"b{c}"), box[i]) for i, c in enumerate(AXES)})
    pairs = pairs.withColumn("r", F.greatest(F.sqrt(_dot("d", "d")), F.lit(1e-9)))
    # positive pushes apart
    push = F.when(F.col("length").isNull(), repel * (near - F.col("r"))).otherwise(stiff * (F.col("length") - F.col("r"))) / F.col("r")
    pairs = pairs.withColumn("push", push)
    sides = F.array(*[F.struct(F.col(k).alias("id"), *[(sign * F.col("push") * F.col(f"d{c}")).alias(f"f{c}") for c in AXES]) for k, sign in (("a", 1.0), ("b", -1.0))])
    forces = pairs.select(F.explode(sides).alias("f")).select("f.*").groupBy("id").agg(*[F.sum(f"f{c}").alias(f"f{c}") for c in AXES])
    moved = atoms.join(forces, "id", "left")
    return moved.select("id", *[F.pmod(F.col(c) + step * F.coalesce(f"f{c}", F.lit(0.0)), F.lit(box[i])).alias(c) for i, c in enumerate(AXES)])


def relax(atoms: DataFrame, bonds: DataFrame, box: Sequence[float], sweeps: int, near: float = 0.26, repel: float = 0.4, stiff: float = 0.4, step: float = 0.5) -> DataFrame:
    """So many steps, with checkpoints."""
    return repeat(atoms.select("id", *[F.col(c).cast("double").alias(c) for c in AXES]), lambda a: relax_step(a, bonds, box, near, repel, stiff, step), sweeps, every=2)
