"""Queries of what is left of the inventory: broadcasting, ordering, integration, similarity, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalar as S
from ..functions.foreign import foreign
from ..operators import distribution, iterate, linalg, relational, validate
from ..operators.background import Background, gather
from ..session import table
from ._registry import query


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity + s_acctbal, 6) AS total FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
""")
def broadcast_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix plus a vector: an equi-join on the trailing index."""
    vector = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("b"))
    return table(spark, sf_dir, "lineitem").join(vector, "l_suppkey").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") + F.col("b"), 6).alias("total"))


@query("SELECT i.range AS i, j.range AS j, k.range AS k, i.range * 3 + j.range + k.range * 10 AS v FROM range(2) i CROSS JOIN range(3) j CROSS JOIN range(4) k")
def broadcast_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(2, 3, 1) + (4,) gives (2, 3, 4): index relations of fixed size."""
    left = spark.range(6).select(F.expr("id div 3").alias("i"), (F.col("id") % 3).alias("j"), F.col("id").alias("a"))
    right = spark.range(4).select(F.col("id").alias("k"), (F.col("id") * 10).alias("b"))
    return left.crossJoin(F.broadcast(right)).select("i", "j", "k", (F.col("a") + F.col("b")).alias("v"))


@query("SELECT n_nationkey, coalesce(array_to_string(list_transform(range(n_nationkey), lambda i: i * i), ','), '') AS squares, length(n_name) AS n FROM nation")
def growing_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    squares = F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(k - 1, F.lit(0))), lambda i: i * i)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(squares, lambda x: x.cast("string")), ",").alias("squares"), F.length("n_name").cast("long").alias("n"))


@query("SELECT event_id, round(value / 256.0, 10) AS pixel, value IS NOT NULL AND NOT isnan(value) AS finite FROM events WHERE NOT (value > 48 AND value < 54)")
def gap_and_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").where(~((v > 48) & (v < 54))).select("event_id", F.round(v / 256.0, 10).alias("pixel"), S.finite(v).alias("finite"))


@query("SELECT w.range::BIGINT AS pos, c_custkey, c_name FROM range(200) w JOIN customer ON c_custkey = 1 + w.range * 7 % 50")
def index_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(200).select(F.col("id").alias("pos"), (F.lit(1) + F.col("id") * 7 % 50).alias("c_custkey"))
    return relational.take_in_order(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", wanted).select("pos", "c_custkey", "c_name")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey")
def stable_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorts aren't stable here, so the position is a key of its own."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey")


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {S.uniform_sql(42, 'c_custkey')}, c_custkey) - 1 AS position FROM customer")
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible shuffle, and each row's place in it."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    return relational.positions(rows, relational.permuted_order(42, F.col("c_custkey")), "c_custkey").select("c_custkey", "position")


def _nbody_sql(steps: int) -> str:
    parts = ["""WITH p0 AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 1000) / 10.0::DOUBLE AS x, (s_suppkey * 104729 % 997) / 10.0::DOUBLE AS y, 0.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, (1 + s_suppkey % 5)::DOUBLE AS m FROM supplier)"""]
    for i in range(steps):
        r = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + 0.0001)"
        parts.append(f"f{i} AS (SELECT a.id, sum(a.m * b.m / ({r} * {r} * {r}) * (b.x - a.x)) AS fx, sum(a.m * b.m / ({r} * {r} * {r}) * (b.y - a.y)) AS fy FROM p{i} a JOIN p{i} b ON a.id <> b.id GROUP BY a.id)")
        parts.append(f"p{i + 1} AS (SELECT p.id, x + (vx + fx / m * 0.01) * 0.01 AS x, y + (vy + fy / m * 0.01) * 0.01 AS y, vx + fx / m * 0.01 AS vx, vy + fy / m * 0.01 AS vy, m FROM p{i} p JOIN f{i} USING (id))")
    return ", ".join(parts) + f" SELECT id, round(x, 4) AS x, round(y, 4) AS y FROM p{steps}"


@query(_nbody_sql(3))
def nbody_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euler steps under softened gravity."""
    k, zero, dt = F.col("s_suppkey"), F.lit(0.0), 0.01
    start = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 7919 % 1000 / 10.0).alias("x"), (k * 104729 % 997 / 10.0).alias("y"), zero.alias("vx"), zero.alias("vy"), (1 + k % 5).cast("double").alias("m"))

    def step(p: DataFrame) -> DataFrame:
        moved = p.join(linalg.gravity(p), "id").withColumns({"vx": F.col("vx") + F.col("fx") / F.col("m") * dt, "vy": F.col("vy") + F.col("fy") / F.col("m") * dt})
        return moved.select("id", (F.col("x") + F.col("vx") * dt).alias("x"), (F.col("y") + F.col("vy") * dt).alias("y"), "vx", "vy", "m")

    return iterate.repeat(start, step, 3, every=2).select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("""
WITH c AS (SELECT l_suppkey % 20 AS i, l_partkey % 50 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
n AS (SELECT i, sqrt(sum(v * v)) AS n FROM c GROUP BY i)
SELECT a.i, b.i AS j, round(sum(a.v * b.v) / any_value(na.n) / any_value(nb.n), 6) AS cosine FROM c a JOIN c b ON a.k = b.k AND a.i < b.i JOIN n na ON na.i = a.i JOIN n nb ON nb.i = b.i GROUP BY a.i, b.i
""")
def sparse_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of sparse rows: a Gram product over the shared items, over the norms."""
    k = F.col
    cells = table(spark, sf_dir, "lineitem").groupBy((k("l_suppkey") % 20).alias("i"), (k("l_partkey") % 50).alias("k")).agg(F.sum("l_quantity").alias("v"))
    norms = cells.groupBy("i").agg(F.sqrt(F.sum(k("v") * k("v"))).alias("n"))
    unit = cells.join(norms, "i").select("i", "k", (k("v") / k("n")).alias("v"))
    pairs = linalg.matmul(unit, unit.select(k("k"), k("i").alias("j"), "v")).where("i < j")
    return pairs.select("i", "j", F.round("v", 6).alias("cosine"))


@query("SELECT range AS i, round(sqrt(range * range + 1), 9) AS value FROM range(200)")
def delayed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arbitrary Python calls as tasks."""
    return distribution.tasks(spark, 200, lambda i: round((i * i + 1) ** 0.5, 9))


@query("SELECT 8::BIGINT AS partitions, count(*) AS rows, true AS even, true AS apart FROM orders")
def scatter_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges over eight partitions: all rows, none of the partitions twice the mean, no range reaching into the next."""
    scattered = distribution.scatter(table(spark, sf_dir, "orders").select("o_orderkey"), 8, "o_orderkey")
    placed = scattered.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("partition", "low", "high"))), lambda p: F.array(p["low"], p["high"]))
    ends = F.flatten(ordered)
    return placed.agg(F.count("*").alias("partitions"), F.sum("rows").alias("rows"), (F.max("rows") < 2 * F.avg("rows")).alias("even"), (ends == F.array_sort(ends)).alias("apart"))


@query("""
WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY 1), b AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT 'v' AS value, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS compared, count(*) FILTER (WHERE b.k IS NULL) AS missing,
       count(*) FILTER (WHERE a.k IS NULL) AS extra, count(*) FILTER (WHERE abs(a.v - b.v) > 0.001) AS differing FROM a FULL JOIN b ON a.k = b.k
""")
def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    totals = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    found = validate.regression(totals(orders.where("o_orderkey % 97 <> 0")), totals(orders), ["k"], ["v"], {"v": validate.Tolerance(0.001)})
    return found.select("value", "compared", "missing", "extra", "differing")


@query(f"SELECT id % 100 AS repetition, round(sum(u * u), 6) AS squares FROM (SELECT range AS id, {S.uniform_sql(5, 'range')} AS u FROM range(100000)) GROUP BY 1")
def repeated_random_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of squares of as many uniform numbers, a hundred times."""
    u = S.uniform(5, F.col("id"))
    return spark.range(100 * 1000).groupBy((F.col("id") % 100).alias("repetition")).agg(F.round(A.sum_of_squares(u), 6).alias("squares"))


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def background_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of three tables by jobs that run side by side, one of them over a table that is persisted meanwhile."""
    with Background(spark, 3) as jobs:
        kept, held = jobs.persist(table(spark, sf_dir, "orders").select("o_orderkey"))
        found = [jobs.submit(table(spark, sf_dir, "nation").count), held, jobs.submit(table(spark, sf_dir, "lineitem").count)]
        counts = gather(found)
        kept.unpersist()
    return spark.createDataFrame(list(zip(("nation", "orders", "lineitem"), counts, strict=True)), "name string, n long")


@query("SELECT event_id, round(cbrt(value), 6) AS root, round(sqrt(value * value + user_id * user_id), 6) AS hypot FROM events")
def foreign_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two functions of the C library, called through its interface."""
    cbrt, hypot = foreign("m", "cbrt"), foreign("m", "hypot", 2)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.round(cbrt("value"), 6).alias("root"), F.round(hypot("value", F.col("user_id").cast("double")), 6).alias("hypot"))


@query("SELECT i.range AS i, round(0.5 * (i.range + 1) * (16 - i.range), 6) AS v FROM range(16) i")
def large_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-x[i-1] + 2 x[i] - x[i+1] = 1 as one system given by its cells, by conjugate gradients."""
    cells = spark.range(16).select("id", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("o")).select(F.col("id").alias("i"), (F.col("id") + F.col("o")).alias("k"), F.when(F.col("o") == 0, 2.0).otherwise(-1.0).alias("v"))
    found = linalg.solve_large(cells.where("k between 0 and 15"), spark.range(16).select(F.col("id").alias("i"), F.lit(1.0).alias("v")))
    return found.select("i", F.round("v", 6).alias("v"))
