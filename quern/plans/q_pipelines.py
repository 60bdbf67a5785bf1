"""Queries of the domain pipelines, over fixtures that are made where they are read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import uniform_sql
from ..operators import spatial, stencil, validate, windows
from ..operators.checkpoints import use_checkpoints
from ..session import table
from ..sources import synthetic
from ..sources.synthetic import double
from . import alignment, builder, climate, lattice, stamps, trajectory, transit, twins
from ._registry import query


_STARS = (6, 1000, 150)


@query(f"WITH {twins.box_search(*_STARS)}, {twins.SEARCH} SELECT star_id, round(period, 9) AS period, round(depth, 9) AS depth, round(sde, 6) AS sde FROM best")
def bls_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves, _ = synthetic.light_curves(spark, *_STARS[:2])
    return transit.search(curves, _STARS[2]).select("star_id", *[F.round(c, n).alias(c) for c, n in (("period", 9), ("depth", 9), ("sde", 6))])


@query(f"""
WITH {twins.box_search(4, 1500, 400)}, {twins.SEARCH},
t AS (SELECT star_id, star_id % 2 = 0 AS planet, sde >= 10 AND (star_id % 2 = 1 OR list_bool_or(list_transform([1, 2, 0.5e0, 3, 1 / 3e0], lambda k: abs(period - (1.2e0 + 0.7e0 * star_id) * k) <= 0.02e0 * (1.2e0 + 0.7e0 * star_id) * k))) AS detected FROM best)
SELECT count(*) FILTER (WHERE detected AND planet) AS tp, count(*) FILTER (WHERE detected AND NOT planet) AS fp, count(*) FILTER (WHERE NOT detected AND planet) AS fn, count(*) FILTER (WHERE NOT detected AND NOT planet) AS tn FROM t
""")
def bls_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves, truth = synthetic.light_curves(spark, 4, 1500)
    return transit.recovery(transit.search(curves, 400), truth)


@query(f"WITH {twins.box_search(4, 1000, 200)} SELECT star_id, round(period, 9) AS period, round(power, 9) AS power FROM spectrum")
def power_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trial periods of each star, a table function with many rows for each group."""
    found = transit.periodogram(synthetic.light_curves(spark, 4, 1000)[0], 200)
    return found.select("star_id", F.round("period", 9).alias("period"), F.round("power", 9).alias("power"))


@query()
def smith_waterman(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, windows, genome, _ = synthetic.reads(spark, 200, 150, 1000, 200_000)
    return alignment.align_reads(reads.repartition(8), windows, genome)


@query(twins.local_alignment("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS q, b.n_name || ' ' || a.n_name || b.n_name AS t FROM nation a CROSS JOIN nation b", ("a", "b")))
def name_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local alignments of all pairs of the 25 nation names, a table of fixed size."""
    nation = table(spark, sf_dir, "nation")
    a, b = (nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"{k}_name")) for k in "ab")
    target = F.concat("b_name", F.lit(" "), "a_name", "b_name")
    pairs = a.crossJoin(F.broadcast(b)).select(F.concat_ws("-", "a", "b").alias("read"), F.col("a_name").alias("query"), target.alias("target"), F.lit(0).alias("start"))
    key = F.split("read", "-")
    return alignment.align_pairs(pairs).select(*[F.get(key, F.lit(i)).cast("int").alias(k) for i, k in enumerate("ab")], "score", "query_end", "target_end")


@query()
def text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and how each benchmark item stands in the documents that share some of its words in a row."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target_id"), F.lower("text").alias("target"))
    return alignment.align_seeded(items, documents, paths=True).withColumnsRenamed({"query_id": "item_id", "target_id": "doc_id"})


@query()
def text_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item against every document that has some of its words in a row: texts as sequences of letters."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("query"))
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("target_id"), F.lower("text").alias("target"))
    return alignment.align_seeded(items, documents).select(F.col("query_id").alias("item_id"), F.col("target_id").alias("doc_id"), "score", "query_end", "target_end")


_CLIMATE = """
c AS (SELECT d.range AS day, x.range // 3 AS lat_i, x.range % 3 AS lon_j,
        290.0::DOUBLE + abs(d.range % 365 - 182) / -12.0::DOUBLE + (d.range * 7919 + x.range * 104729 + d.range // 9 * 1299709) % 1200 / 100.0::DOUBLE AS t,
        greatest((d.range * 15485863 + x.range * 32452843 + d.range // 4 * 49979687) % 700 / 100.0::DOUBLE - 4.0, 0.0) AS pr, d.range // 365 AS year, d.range % 365 AS doy
      FROM range(1095) d CROSS JOIN range(6) x),
thr AS (SELECT lat_i, lon_j, (doy + o.range + 363) % 365 AS doy, quantile_cont(t, 0.9) AS threshold FROM c CROSS JOIN range(5) o GROUP BY 1, 2, 3),
normal AS (SELECT lat_i, lon_j, doy, avg(t) AS normal FROM c GROUP BY 1, 2, 3),
hot AS (SELECT lat_i, lon_j, year, doy - row_number() OVER (PARTITION BY lat_i, lon_j, year ORDER BY doy) AS g FROM c JOIN normal USING (lat_i, lon_j, doy) WHERE t > normal + 5),
warm AS (SELECT lat_i, lon_j, year, sum(n) AS days FROM (SELECT lat_i, lon_j, year, count(*) AS n FROM hot GROUP BY lat_i, lon_j, year, g) WHERE n >= 6 GROUP BY 1, 2, 3),
dry AS (SELECT lat_i, lon_j, year, doy - row_number() OVER (PARTITION BY lat_i, lon_j, year ORDER BY doy) AS g FROM c WHERE pr < 1.0),
longest AS (SELECT lat_i, lon_j, year, max(n) AS days FROM (SELECT lat_i, lon_j, year, count(*) AS n FROM dry GROUP BY lat_i, lon_j, year, g) GROUP BY 1, 2, 3)"""


_CLIMATE_SQL = f"""
WITH {_CLIMATE}
SELECT c.lat_i::INTEGER AS lat_i, c.lon_j::INTEGER AS lon_j, c.year::INTEGER AS year, round(count(*) FILTER (WHERE t > threshold) / 365.0, 6) AS tx90p,
       coalesce(any_value(w.days), 0)::DOUBLE AS hwdi, round(sum(greatest(t - 283.15, 0)), 4) AS gdd, coalesce(any_value(l.days), 0)::DOUBLE AS cdd
FROM c JOIN thr USING (lat_i, lon_j, doy) LEFT JOIN warm w ON w.lat_i = c.lat_i AND w.lon_j = c.lon_j AND w.year = c.year
LEFT JOIN longest l ON l.lat_i = c.lat_i AND l.lon_j = c.lon_j AND l.year = c.year GROUP BY c.lat_i, c.lon_j, c.year
"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select(*climate.YEAR, F.round("tx90p", 6).alias("tx90p"), "hwdi", F.round("gdd", 4).alias("gdd"), "cdd")


@query(_CLIMATE_SQL)
def climate_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(climate.indices(synthetic.climate(spark, 3, 2, 3)))


@query(_CLIMATE_SQL)
def climate_indices_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(climate.indices_by_cell(synthetic.climate(spark, 3, 2, 3)))


_GRIDS = {"cylinder": (30, 18, 4, 60.0), "cavity": (24, 20, 4, 50.0)}


def _lattice(spark: SparkSession, case: str) -> DataFrame:
    wall = lambda c: (F.round(c, 9) + 0.0).alias(c)
    return lattice.run(spark, case, *_GRIDS[case]).select("x", "y", wall("ux"), wall("uy"), F.round("rho", 9).alias("rho"), "solid")


@query(twins.lattice_steps("cylinder", *_GRIDS["cylinder"]))
def lbm_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few steps of a grid of cells as plans."""
    return _lattice(spark, "cylinder")


@query(twins.lattice_steps("cavity", *_GRIDS["cavity"]))
def lbm_cavity_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lattice(spark, "cavity")


@query()
def lbm_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep of small grids, one a task."""
    cases = [("cavity-100", "cavity", 40, 40, 300, 100.0, 0), ("cylinder-100", "cylinder", 100, 40, 500, 100.0, 4), ("cylinder-200", "cylinder", 100, 40, 500, 200.0, 4)]
    return lattice.sweep(spark.createDataFrame(cases, "name string, case string, nx int, ny int, steps int, reynolds double, sample_every int").repartition(3, "name"))


_SYSTEM = (12, 200, 5, 2.4)
BOX = (_SYSTEM[3],) * 3
_ATOMS = twins.with_trajectory(*_SYSTEM)


def _trajectory(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The system, its frames written once."""
    use_checkpoints(spark)
    traj, topology, roles = synthetic.trajectory(spark, *_SYSTEM)
    return traj.checkpoint(), topology, roles


@query(f"WITH {_ATOMS}, {twins.distribution(_SYSTEM[3], *_SYSTEM[1:3])} SELECT bin::INTEGER AS bin, round(r, 6) AS r, hist, round(g, 6) AS g FROM gr")
def trajectory_rdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, topology, _ = _trajectory(spark)
    return trajectory.pair_distribution(traj, topology, BOX).select("bin", F.round("r", 6).alias("r"), "hist", F.round("g", 6).alias("g"))


@query(f"WITH {_ATOMS}, {twins.distribution(_SYSTEM[3], *_SYSTEM[1:3])} SELECT round(arg_max(r, {{'g': g, 'b': -bin}}), 6) AS r, round(max(g), 6) AS g FROM gr")
def trajectory_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, topology, _ = _trajectory(spark)
    return trajectory.first_peak(trajectory.pair_distribution(traj, topology, BOX)).select(F.round("r", 6).alias("r"), F.round("g", 6).alias("g"))


@query(f"WITH {_ATOMS} SELECT f.frame, count(donor) AS hbonds FROM (SELECT DISTINCT frame FROM traj) f LEFT JOIN bonds ON bonds.frame = f.frame GROUP BY f.frame")
def trajectory_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, _, roles = _trajectory(spark)
    return trajectory.bond_counts(traj, roles, BOX)


@query(f"WITH {_ATOMS} SELECT a.frame, count(*) AS kept FROM bonds a JOIN bonds b ON b.frame = a.frame + 1 AND b.donor = a.donor AND b.acceptor = a.acceptor GROUP BY a.frame")
def bond_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrogen bonds that still exist one frame later."""
    traj, _, roles = _trajectory(spark)
    return windows.lagged_overlap(spatial.hydrogen_bonds(traj.withColumnRenamed("atom", "id"), roles, BOX), "frame", ["donor", "acceptor"], 1)


@query(f"WITH {_ATOMS}, {twins.contacts(_SYSTEM[3])} SELECT frame, round(q, 9) AS q FROM q")
def trajectory_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, topology, _ = _trajectory(spark)
    return trajectory.native_contacts(traj, topology, BOX).select("frame", F.round("q", 9).alias("q"))


@query(f"""
WITH {_ATOMS}, {twins.distribution(_SYSTEM[3], *_SYSTEM[1:3])}, {twins.contacts(_SYSTEM[3])},
h AS (SELECT f.frame, count(donor) AS n FROM (SELECT DISTINCT frame FROM traj) f LEFT JOIN bonds ON bonds.frame = f.frame GROUP BY f.frame),
c AS (SELECT (SELECT arg_max(r, {{'g': g, 'b': -bin}}) FROM gr) AS peak, (SELECT max(g) FROM gr WHERE r < 0.15) AS core,
      (SELECT stddev_pop(n) / greatest(avg(n), 1e-9) FROM h) AS variation, (SELECT min(q) FROM q) AS least_q)
SELECT round(peak, 6) AS peak, round(core, 6) AS core, round(variation, 6) AS variation, round(least_q, 6) AS least_q,
       peak BETWEEN 0.24 AND 0.34 AND coalesce(core, 0) <= 0.05 AND variation <= 0.25 AND least_q >= 0.7 AS ok FROM c
""")
def trajectory_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, topology, roles = _trajectory(spark)
    found = validate.trajectory_sanity(trajectory.pair_distribution(traj, topology, BOX), trajectory.bond_counts(traj, roles, BOX), trajectory.native_contacts(traj, topology, BOX))
    return found.select(*[F.round(c, 6).alias(c) for c in ("peak", "core", "variation", "least_q")], "ok")


@query("""
WITH s AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 190)::DOUBLE + 0.25 AS x, (s_suppkey * 53 % 90)::DOUBLE + 0.25 AS y FROM supplier),
d AS (SELECT range::INTEGER AS det_num, range * 60 AS x0, 0 AS y0, 64 AS nx, 64 AS ny FROM range(3)),
p AS (SELECT id, min(det_num) AS det_num FROM s JOIN d ON x - x0 > 0 AND x - x0 <= nx AND y - y0 > 0 AND y - y0 <= ny GROUP BY id),
g AS (SELECT s.id, p.det_num, v.range AS sy, u.range AS sx, round_even(y - 0, 0) - 4 + v.range AS py, round_even(x - 60 * p.det_num, 0) - 4 + u.range AS px
      FROM s JOIN p USING (id) CROSS JOIN range(8) v CROSS JOIN range(8) u)
SELECT id, sum(CASE WHEN py BETWEEN 0 AND 63 AND px BETWEEN 0 AND 63 THEN (py * 64 + px + det_num) % 97 ELSE 0 END)::BIGINT AS sci,
       sum(CASE WHEN py BETWEEN 0 AND 63 AND px BETWEEN 0 AND 63 THEN 0 ELSE 1 END)::BIGINT AS flg, count(*) AS n FROM g GROUP BY id
""")
def stamp_cutout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    catalog = table(spark, sf_dir, "supplier").select(k.alias("id"), ((k * 37 % 190).cast("double") + 0.25).alias("x"), ((k * 53 % 90).cast("double") + 0.25).alias("y"))
    detectors = spark.range(3).select(F.col("id").cast("int").alias("det_num"), (F.col("id") * 60).alias("x0"), F.lit(0).alias("y0"), F.lit(64).alias("nx"), F.lit(64).alias("ny"))
    at = spark.range(3 * 4096).select(F.expr("cast(id div 4096 as int)").alias("det_num"), F.expr("cast(id % 4096 div 64 as int)").alias("y"), (F.col("id") % 64).cast("int").alias("x"))
    pixels = at.withColumn("sci", (F.col("y") * 64 + F.col("x") + F.col("det_num")) % 97).withColumn("flg", F.lit(0))
    found = stamps.stamps(catalog, detectors, pixels, 8)
    return found.groupBy("id").agg(F.sum("sci").alias("sci"), F.sum("flg").alias("flg"), F.count("*").alias("n"))


_TONES = "SELECT n_nationkey AS series, i.range AS i, sin(2 * pi() * (20 + 3 * n_nationkey) * i.range / 512) + 0.5 * sin(2 * pi() * (101 + n_nationkey) * i.range / 512) AS v FROM nation CROSS JOIN range(512) i"


@query(f"""
WITH s AS MATERIALIZED ({_TONES}), d AS (SELECT series, k.range AS k, sum(v * cos(2 * pi() * (i * k.range % 512) / 512)) AS re, sum(v * sin(2 * pi() * (i * k.range % 512) / 512)) AS im FROM s CROSS JOIN range(1, 257) k GROUP BY 1, 2)
SELECT series::INTEGER AS series, arg_max(k, re * re + im * im)::DOUBLE AS frequency, round(sqrt(max(re * re + im * im)), 6) AS amplitude FROM d GROUP BY series
""")
def fft_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest frequency of each of many two-tone signals, a signal a group."""
    k = F.col("n_nationkey")
    turn = lambda f: F.sin(F.lit(2 * math.pi) * f * F.col("i") / 512)
    rows = table(spark, sf_dir, "nation").select(k.cast("int").alias("series"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(511))).alias("i"))
    signals = rows.select("series", (F.col("i") / 512.0).alias("t"), (turn(20 + 3 * k) + 0.5 * turn(101 + k)).alias("v"))
    return lattice.spectral_peaks(signals, "series").select("series", F.round("frequency", 6).alias("frequency"), F.round("amplitude", 6).alias("amplitude"))


# ---------------------------------------------------------------- what the inventory names beyond the baselines

_WALK = (0.05, 0.08, 1.2)


def _unit_sql(seed: int, *keys: str) -> str:
    v = [f"({uniform_sql(seed + k, *keys)} - 0.5e0)" for k in range(3)]
    n = " + ".join(f"{x} * {x}" for x in v)
    return ", ".join(f"{x} / greatest(sqrt({n}), 1e-12) AS s{c}" for c, x in zip("xyz", v, strict=True))


@query(f"""
WITH s AS (SELECT range // 40 AS chain, range % 40 AS i, {_unit_sql(3, "range")} FROM range(200))
SELECT a.chain, a.i, {", ".join(f"round({_WALK[2]}e0 + sum(pow({1 - _WALK[1]}e0, a.i - b.i + 1) * {_WALK[0]}e0 * b.s{c}), 6) AS {c}" for c in "xyz")}
FROM s a JOIN s b ON a.chain = b.chain AND b.i <= a.i GROUP BY a.chain, a.i
""")
def chain_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains that wander and are drawn back to the centre."""
    steps = builder.directions(spark.range(200).select("id", F.expr("id div 40").alias("chain"), (F.col("id") % 40).alias("i")), 3, F.col("id"))
    return builder.random_walk(steps, (_WALK[2],) * 3, *_WALK[:2]).select("chain", "i", *[F.round(c, 6).alias(c) for c in "xyz"])


def _wrap_sql(e: str) -> str:
    b = double(_SYSTEM[3])
    return f"round(({e}) - {b} * floor(({e}) / {b}), 6)"


def _apart_sql(a: str, b: str) -> list[str]:
    box = double(_SYSTEM[3])
    return [f"(({a}.{c} - {b}.{c}) - {box} * round_even(({a}.{c} - {b}.{c}) / {box}, 0))" for c in "xyz"]


_FIRST = "o AS (SELECT atom AS id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM traj JOIN topology USING (atom) WHERE frame = 0 AND type = 1)"
_HYPOT = lambda a, b: " + ".join(f"{a}{c} * {b}{c}" for c in "xyz")


@query(f"""
WITH {_ATOMS}, {_FIRST},
n AS (SELECT a, arg_min(b, {{'r': r2, 'b': b}}) AS p FROM (SELECT a.id AS a, b.id AS b, {" + ".join(f"{d} * {d}" for d in _apart_sql("a", "b"))} AS r2 FROM o a JOIN o b ON a.id <> b.id) WHERE r2 <= 0.32e0 * 0.32e0 GROUP BY a),
f AS (SELECT id, {_unit_sql(70, "id").replace(" AS s", " AS f")} FROM o), s AS (SELECT id, {_unit_sql(73, "id")} FROM o),
w AS (SELECT o.id, o.x, o.y, o.z, {", ".join(f"CASE WHEN p.id IS NULL THEN f.f{c} ELSE {d} END AS w{c}" for c, d in zip("xyz", _apart_sql("p", "o"), strict=True))}
      FROM o JOIN f USING (id) LEFT JOIN n ON n.a = o.id LEFT JOIN o p ON p.id = n.p),
u AS (SELECT id, x, y, z, {", ".join(f"w{c} / greatest(sqrt({_HYPOT('w', 'w')}), 1e-12) AS u{c}" for c in "xyz")} FROM w),
q AS (SELECT u.*, {", ".join(f"s{c} - ({_HYPOT('s', 'u')}) * u{c} AS q{c}" for c in "xyz")} FROM u JOIN s USING (id))
SELECT id, 1 AS h, {", ".join(f"{_wrap_sql(f'{c} + 0.0957e0 * u{c}')} AS {c}" for c in "xyz")} FROM q
UNION ALL SELECT id, 2, {", ".join(_wrap_sql(f"{c} + 0.0957e0 * ({double(math.cos(builder.ANGLE))} * u{c} + {double(math.sin(builder.ANGLE))} * q{c} / greatest(sqrt({_HYPOT('q', 'q')}), 1e-12))") for c in "xyz")} FROM q
""")
def water_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hydrogens that point at the nearest other oxygen."""
    traj, topology, _ = _trajectory(spark)
    oxygens = traj.where("frame = 0").join(topology.where("type = 1").select("atom"), "atom").select(F.col("atom").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return builder.oriented(oxygens, BOX, 0.32, 0.0957, 70).select("id", "h", *[F.round(c, 6).alias(c) for c in "xyz"])


def _relaxed_sql(source: str) -> str:
    d = _apart_sql("a", "b")
    pairs = f"SELECT a.id AS a, b.id AS b, NULL::DOUBLE AS length FROM {source} a JOIN {source} b ON a.id < b.id WHERE {' + '.join(f'{x} * {x}' for x in d)} <= 0.26e0 * 0.26e0 UNION ALL SELECT a, b, length FROM bond"
    pushed = f"SELECT p.a, p.b, p.length, {', '.join(f'{x} AS d{c}' for c, x in zip('xyz', d, strict=True))} FROM ({pairs}) p JOIN {source} a ON a.id = p.a JOIN {source} b ON b.id = p.b"
    force = f"SELECT *, CASE WHEN length IS NULL THEN 0.4e0 * (0.26e0 - r) ELSE 0.4e0 * (length - r) END / r AS push FROM (SELECT *, greatest(sqrt({_HYPOT('d', 'd')}), 1e-9) AS r FROM ({pushed}))"
    sums = ", ".join(f"sum(f{c}) AS f{c}" for c in "xyz")
    rows = " UNION ALL ".join(f"SELECT {k} AS id, {', '.join(f'{sign} * push * d{c} AS f{c}' for c in 'xyz')} FROM force" for k, sign in (("a", 1), ("b", -1)))
    box = double(_SYSTEM[3])
    moved = ", ".join(f"({c} + 0.5e0 * coalesce(f{c}, 0)) - {box} * floor(({c} + 0.5e0 * coalesce(f{c}, 0)) / {box}) AS {c}" for c in "xyz")
    return f"WITH force AS ({force}) SELECT s.id, {moved} FROM {source} s LEFT JOIN (SELECT id, {sums} FROM ({rows}) GROUP BY id) USING (id)"


@query(f"""
WITH {_ATOMS}, m0 AS (SELECT atom AS id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM traj WHERE frame = 0),
bond AS (SELECT atom AS a, atom + 1 AS b, 0.2e0 AS length FROM topology WHERE type = 0 AND atom + 1 < {_SYSTEM[0]} UNION ALL SELECT t.atom, t.atom + h.range, 0.1e0 FROM topology t CROSS JOIN range(1, 3) h WHERE type = 1),
m1 AS MATERIALIZED ({_relaxed_sql("m0")}), m2 AS MATERIALIZED ({_relaxed_sql("m1")})
SELECT id, {", ".join(f"round({c}, 6) AS {c}" for c in "xyz")} FROM m2
""")
def relaxed_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overdamped steps under repulsion and bonds."""
    traj, topology, _ = _trajectory(spark)
    chain = topology.where(f"type = 0 and atom + 1 < {_SYSTEM[0]}").select(F.col("atom").alias("a"), (F.col("atom") + 1).alias("b"), F.lit(0.2).alias("length"))
    waters = topology.where("type = 1").select(F.col("atom").alias("a"), F.explode(F.array(F.col("atom") + 1, F.col("atom") + 2)).alias("b"), F.lit(0.1).alias("length"))
    atoms = traj.where("frame = 0").select(F.col("atom").alias("id"), *"xyz")
    return builder.relax(atoms, chain.unionByName(waters), BOX, 2).select("id", *[F.round(c, 6).alias(c) for c in "xyz"])


@query(f"WITH {_ATOMS} SELECT atom, round(sqrt(var_pop(x::DOUBLE) + var_pop(y::DOUBLE) + var_pop(z::DOUBLE)), 6) AS rmsf FROM traj JOIN topology USING (atom) WHERE type = 0 GROUP BY atom")
def trajectory_fluctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, topology, _ = _trajectory(spark)
    return trajectory.fluctuation(traj.join(topology.where("type = 0").select("atom"), "atom")).select("atom", F.round("rmsf", 6).alias("rmsf"))


@query()
def trajectory_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the chain from its first frame after the best fit."""
    traj, topology, _ = _trajectory(spark)
    return trajectory.deviation(traj, topology.where("type = 0")).select("frame", F.round("rmsd", 6).alias("rmsd"))


@query(f"""
WITH {_ATOMS}, a AS (SELECT atom AS id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, 0.1e0 + 0.05e0 * (atom % 2) + 0.14e0 AS reach FROM traj WHERE frame = 0 AND atom < 120),
p AS (SELECT range AS k, 1 - 2 * (range + 0.5e0) / 60 AS h, {double(math.pi * (3 - math.sqrt(5)))} * (range + 0.5e0) AS turn FROM range(60)),
s AS (SELECT id, k, a.x + reach * sqrt(1 - h * h) * cos(turn) AS x, a.y + reach * sqrt(1 - h * h) * sin(turn) AS y, a.z + reach * h AS z FROM a CROSS JOIN p),
c AS (SELECT DISTINCT a.id, k FROM s a JOIN a b ON a.id <> b.id WHERE {" + ".join(f"{x} * {x}" for x in _apart_sql("a", "b"))} < reach * reach * (1 - 1e-12))
SELECT a.id, round({double(4 * math.pi / 60)} * any_value(reach) * any_value(reach) * (60 - count(c.k)), 6) AS area FROM a LEFT JOIN c USING (id) GROUP BY a.id
""")
def accessible_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    traj, _, _ = _trajectory(spark)
    atoms = traj.where("frame = 0 and atom < 120").select(F.col("atom").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], (F.lit(0.1) + 0.05 * (F.col("atom") % 2)).alias("radius"))
    return trajectory.surface(atoms, BOX).select("id", F.round("area", 6).alias("area"))


@query(f"""
WITH {_CLIMATE}, h AS (SELECT lat_i, lon_j, quantile_cont(pr, 0.95) AS heavy FROM c WHERE pr >= 1 GROUP BY 1, 2)
SELECT lat_i::INTEGER AS lat_i, lon_j::INTEGER AS lon_j, year::INTEGER AS year, count(*) FILTER (WHERE t < 283.15) AS frost, round(sum(CASE WHEN pr > heavy THEN pr ELSE 0 END), 4) AS r95ptot
FROM c LEFT JOIN h USING (lat_i, lon_j) GROUP BY 1, 2, 3
""")
def climate_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return climate.extremes(synthetic.climate(spark, 3, 2, 3), cold=283.15).select(*climate.YEAR, "frost", F.round("r95ptot", 4).alias("r95ptot"))


#: star, period, middle, duration and depth of transits that are put in.
_PLANETS = ((11, 3.3, 0.7, 0.2, 0.02), (13, 2.1, 0.4, 0.1, 1e-6))
_PUT = "pl AS (SELECT * FROM (VALUES " + ", ".join(f"({p[0]}, {', '.join(map(double, p[1:]))})" for p in _PLANETS) + ") v(star_id, p, c, d, h))"
_OFF = "(t - c + p / 2) - p * floor((t - c + p / 2) / p) - p / 2"


@query(f"""
WITH {_PUT}, {twins.box_search(4, 1500, 400, curves=f"SELECT star_id + 10 AS star_id, t, CASE WHEN abs({_OFF}) < d / 2 THEN flux * (1 - h) ELSE flux END AS flux, flux_err FROM made JOIN pl ON pl.star_id = made.star_id + 10".replace("SELECT star_id + 10", "SELECT made.star_id + 10"))}, {twins.SEARCH},
t AS (SELECT sde >= 10 AND list_bool_or(list_transform([1, 2, 0.5e0, 3, 1 / 3e0], lambda k: abs(period - p * k) <= 0.02e0 * p * k)) AS found FROM best JOIN pl USING (star_id))
SELECT count(*) FILTER (WHERE found) AS tp, 0::BIGINT AS fp, count(*) FILTER (WHERE NOT found) AS fn, 0::BIGINT AS tn FROM t
""")
def injection_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transits put into curves and searched for: recovered or missed."""
    curves, _ = synthetic.light_curves(spark, 4, 1500)
    quiet = curves.where("star_id % 2 = 1").withColumn("star_id", F.col("star_id") + 10)
    planets = spark.createDataFrame(list(_PLANETS), "star_id int, period double, t0 double, duration double, depth double")
    return transit.recovery(transit.search(transit.injected(quiet, planets), 400), planets.withColumn("has_planet", F.lit(1)))


@query("SELECT r.range AS r, ((r.range * 37 + 7 * 17) % 101)::DOUBLE AS v FROM range(30) r")
def centreline_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.range(600).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"))
    return stencil.profile(cells.withColumn("v", ((F.col("r") * 37 + F.col("c") * 17) % 101).cast("double")), "c", 7).select("r", "v")
