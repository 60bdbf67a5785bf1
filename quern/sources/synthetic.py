"""Sources without files: constructors, grids, masks and fixtures from hashed numbers (survey S20-S32)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import standard_normal, standard_normal_sql, uniform, with_uniforms_sql

SEED = 20260810


def matrix(spark: SparkSession, rows: int, columns: int, fill: float | None = None) -> DataFrame:
    """(i, j, v): constant, or the row-major index where there is no fill."""
    cells = spark.range(rows * columns)
    return cells.select(F.expr(f"id div {columns}").alias("i"), (F.col("id") % columns).alias("j"), (F.col("id").cast("double") if fill is None else F.lit(float(fill))).alias("v"))


def linspace(spark: SparkSession, low: float, high: float, n: int) -> DataFrame:
    return spark.range(n).select("id", (F.lit(low) + F.col("id") * F.lit((high - low) / max(1, n - 1))).alias("v"))


def random_matrix(spark: SparkSession, rows: int, columns: int, seed: int = SEED) -> DataFrame:
    return matrix(spark, rows, columns).withColumn("v", uniform(seed, F.col("i"), F.col("j")))


def blobs(spark: SparkSession, n: int, centres: tuple[tuple[float, float], ...], spread: float = 1.0, seed: int = SEED) -> DataFrame:
    """(id, x, y, centre): normal noise round the centres in turn."""
    k = F.col("id") % len(centres)
    at = lambda axis: F.element_at(F.array(*[F.lit(float(c[axis])) for c in centres]), (k + 1).cast("int"))
    return spark.range(n).select("id", (at(0) + spread * standard_normal(seed, F.col("id"))).alias("x"), (at(1) + spread * standard_normal(seed + 2, F.col("id"))).alias("y"), k.alias("centre"))


def double(x: float) -> str:
    """A number as text that any SQL reads as a double."""
    return repr(float(x)) if "e" in repr(float(x)) else f"{float(x)!r}e0"


def light_curves_text(stars: int, points: int, days: float = 27.4, seed: int = SEED) -> str:
    """The curves of light_curves as a query that Spark and other engines read alike."""
    period = "(1.2e0 + 0.7e0 * star_id)"
    at = f"((t - 0.3e0 * {period}) / {period})"
    phase = f"({at} - floor({at}))"
    dip = f"CASE WHEN star_id % 2 = 0 AND ({phase} < 0.02e0 OR {phase} > 0.98e0) THEN 0.01e0 ELSE 0e0 END"
    trend = f"(1e0 + 0.01e0 * sin(t * {double(2 * math.pi / 9.0)} + star_id))"
    every = f"SELECT id, CAST(floor(id / {points}) AS INT) AS star_id, (id % {points}) * {double(days / points)} AS t FROM range({stars * points}) AS r(id)"
    kept = f"SELECT * FROM ({every}) AS a WHERE NOT (t > {double(0.48 * days)} AND t < {double(0.54 * days)})"
    return f"SELECT star_id, t, {trend} * (1e0 - {dip}) + 0.001e0 * {standard_normal_sql(seed, 'id')} AS flux, 0.001e0 AS flux_err FROM ({kept}) AS b"


def light_curves(spark: SparkSession, stars: int, points: int, days: float = 27.4, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Curves with a slow trend, white noise and a transit on every second star, and the truth; samples near the middle are missing."""
    curves = spark.sql(light_curves_text(stars, points, days, seed))
    has = F.col("star_id") % 2 == 0
    truth = spark.range(stars).select(F.col("id").cast("int").alias("star_id"))
    return curves, truth.select("star_id", has.cast("int").alias("has_planet"), F.when(has, F.lit(1.2) + 0.7 * F.col("star_id")).otherwise(float("nan")).alias("period"))


def reads(spark: SparkSession, n: int, length: int, window: int, reference: int, seed: int = SEED) -> tuple[DataFrame, ...]:
    """(reads, windows, reference, truth): mutated cuts of a random genome; a small fixture, made on the driver."""
    rng = np.random.default_rng(seed)
    genome = "".join(rng.choice(list("ACGT"), reference))
    rows, places, truth = [], [], []
    for i in range(n):
        origin = int(rng.integers(0, reference - length))
        cut, subs, indels = list(genome[origin : origin + length]), 0, 0
        for j in range(length):
            if rng.random() < 0.02:
                cut[j], subs = str(rng.choice([c for c in "ACGT" if c != cut[j]])), subs + 1
            elif rng.random() < 0.004:
                cut[j], indels = "" if rng.random() < 0.5 else cut[j] + str(rng.choice(list("ACGT"))), indels + 1
        start = max(0, min(reference - window, origin - int(rng.integers(0, window - length))))
        rows.append((f"read{i:06d}", "".join(cut)))
        places.append((f"read{i:06d}", start, start + window))
        truth.append((f"read{i:06d}", origin, subs, indels))
    make = lambda data, schema: spark.createDataFrame(pd.DataFrame(data, columns=[c.split()[0] for c in schema.split(", ")]), schema)
    return make(rows, schemas.SEQUENCE), make(places, schemas.WINDOWS), make([("genome", genome)], schemas.SEQUENCE), make(truth, schemas.READ_TRUTH)


def climate(spark: SparkSession, years: int, lat: int, lon: int) -> DataFrame:
    """A seasonal cycle with weather from integer arithmetic, so that SQL can make the same table."""
    days, cells = 365 * years, lat * lon
    cell, day = F.col("id") % cells, F.expr(f"id div {cells}")
    base = spark.range(days * cells).select(day.cast("int").alias("day"), F.expr(f"cast((id % {cells}) div {lon} as int)").alias("lat_i"), (F.col("id") % lon).cast("int").alias("lon_j"), cell.alias("cell"))
    d, c = F.col("day").cast("long"), F.col("cell")
    weather = (d * 7919 + c * 104729 + F.expr("cast(day as bigint) div 9") * 1299709) % 1200 / 100.0
    season = F.abs(d % 365 - 182) / -12.0
    rain = (d * 15485863 + c * 32452843 + F.expr("cast(day as bigint) div 4") * 49979687) % 700 / 100.0
    return base.select("day", "lat_i", "lon_j", (F.lit(290.0) + season + weather).alias("tasmax"), F.greatest(rain - 4.0, F.lit(0.0)).alias("pr"))


#: Distance of an oxygen from its hydrogens, of rows of waters, and the direction of the second hydrogen.
ARM, ROW, SECOND = 0.0957, 0.3, (-0.25038, 0.96815, 0.0)


def trajectory_text(chain: int, waters: int, frames: int, box: float, seed: int = SEED) -> dict[str, str]:
    """traj, topology and roles of trajectory(), each as a query that Spark and other engines read alike."""
    atoms, sides = chain + 3 * waters, [max(1, int(box / d)) for d in (ROW, ROW * math.sqrt(0.75), ROW)]
    if waters > sides[0] * sides[1] * sides[2]:
        raise ValueError(f"a box of {box} has room for {sides[0] * sides[1] * sides[2]} waters")
    site = f"CASE WHEN atom < {chain} THEN 0 ELSE (atom - {chain}) % 3 END"
    owner = f"CASE WHEN atom < {chain} THEN atom ELSE CAST(floor((atom - {chain}) / 3) AS INT) END"
    named = f"SELECT *, {site} AS site, {owner} AS w FROM (SELECT CAST(floor(id / {atoms}) AS INT) AS frame, CAST(id % {atoms} AS INT) AS atom FROM range({frames * atoms}) AS r(id)) AS a"
    row = f"(floor(w / {sides[0]}) % {sides[1]})"
    places = (f"(w % {sides[0]} + 0.5e0 * ({row} % 2) + 0.25e0)", f"({row} + 0.5e0)", f"(floor(w / {sides[0] * sides[1]}) + 0.5e0)")
    # the place of an owner, its shake in a frame, and that of a hydrogen
    draws = {f"{name}{k}": (seed % 1000 + at + k, keys) for at, name, keys in ((0, "home", ("w",)), (10, "shake", ("w", "frame")), (20, "swing", ("atom", "frame"))) for k in range(3)}
    axes = []
    for k, place in enumerate(places):
        link = f"{double(box / 2)} + {double(min(0.6 * box, 0.25 * chain ** (1 / 3)))} * (home{k} - 0.5e0)"
        oxygen = f"{double(box / sides[k])} * {place} + 0.02e0 * (home{k} - 0.5e0)"
        arm = f"CASE site WHEN 1 THEN {double(ARM * (k == 0))} WHEN 2 THEN {double(ARM * SECOND[k])} ELSE 0e0 END + CASE WHEN site > 0 THEN 0.02e0 * (swing{k} - 0.5e0) ELSE 0e0 END"
        axes.append(f"CASE WHEN atom < {chain} THEN {link} ELSE {oxygen} + {arm} END + 0.02e0 * (shake{k} - 0.5e0) AS {'xyz'[k]}")
    wrapped = ", ".join(f"CAST({c} - {double(box)} * floor({c} / {double(box)}) AS FLOAT) AS {c}" for c in "xyz")
    traj = f"SELECT frame, atom, {wrapped} FROM (SELECT frame, atom, {', '.join(axes)} FROM ({with_uniforms_sql(named, draws)}) AS b) AS c"
    kind = f"CASE WHEN atom < {chain} THEN 0 WHEN site = 0 THEN 1 ELSE 2 END"
    resid = f"CASE WHEN atom < {chain} THEN w ELSE w + {chain} END"
    single = f"SELECT * FROM ({named}) AS b WHERE frame = 0"
    topology = f"SELECT atom, CASE {kind} WHEN 0 THEN 'CA' WHEN 1 THEN 'OW' ELSE 'HW' END AS name, {kind} AS type, {resid} AS resid FROM ({single}) AS c"
    of = lambda where, role: f"SELECT atom, '{role}' AS role FROM ({topology}) AS t WHERE {where}"
    roles = " UNION ALL ".join([of("type = 1", "donor"), of("type = 1 OR (type = 0 AND atom % 3 = 1)", "acceptor"), of("type = 2", "hydrogen")])
    return {"traj": traj, "topology": topology, "roles": roles}


def trajectory(spark: SparkSession, chain: int, waters: int, frames: int, box: float = 2.4, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traj, topology, roles): a globule of a chain, and three-site waters in staggered rows, each aiming one hydrogen at the next in
    its row, in a periodic box; all jitter from frame to frame. Made in the JVM, any size."""
    made = trajectory_text(chain, waters, frames, box, seed)
    return tuple(spark.sql(made[name]) for name in ("traj", "topology", "roles"))
