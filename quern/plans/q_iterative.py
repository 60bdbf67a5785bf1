"""Queries of iterative and learning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import iterate, leastsq, linalg, ml
from ..session import table
from ._registry import query

_CENTRES = ((5.0, 910.0), (25.0, 950.0), (45.0, 990.0))


def _kmeans_sql(steps: int) -> str:
    parts = ["WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)"]
    parts.append("c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE)" for k, (x, y) in enumerate(_CENTRES)) + ") v(k, x, y))")
    for i in range(steps):
        near = f"SELECT p_partkey, p.x, p.y, arg_min(c.k, {{'d': (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y), 'k': c.k}}) AS k FROM p CROSS JOIN c{i} c GROUP BY p_partkey, p.x, p.y"
        parts.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y FROM c{i} c LEFT JOIN (SELECT k, avg(x) AS x, avg(y) AS y FROM ({near}) GROUP BY k) m ON m.k = c.k)")
    return ", ".join(parts) + f" SELECT k, round(x, 6) AS x, round(y, 6) AS y FROM c{steps}"


@query(_kmeans_sql(3))
def kmeans_fixed_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    centres = iterate.kmeans(points, _CENTRES, ("x", "y"), max_steps=3, tolerance=0.0)
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(centres)], "k int, x double, y double").select("k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""
SELECT round(regr_slope(l_tax, l_discount), 6) AS slope, round(regr_intercept(l_tax, l_discount), 6) AS intercept, round(regr_r2(l_tax, l_discount), 6) AS r2 FROM lineitem
""")
def linear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    intercept, slope = iterate.linear_regression(items, ["l_discount"], "l_tax")
    return items.agg(F.round(F.lit(slope), 6).alias("slope"), F.round(F.lit(intercept), 6).alias("intercept"), F.round(F.regr_r2("l_tax", "l_discount"), 6).alias("r2"))


@query("""
WITH RECURSIVE s AS (SELECT count(*) AS n, sum(l_discount) AS x, sum(l_discount * l_discount) AS xx, sum(l_tax) AS y, sum(l_discount * l_tax) AS xy FROM lineitem),
w AS (SELECT 0 AS i, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a
  UNION ALL SELECT i + 1, b - 0.1 * 2 / n * (n * b + x * a - y), a - 0.1 * 2 / n * (x * b + xx * a - xy) FROM w CROSS JOIN s WHERE i < 100)
SELECT round(b, 6) AS intercept, round(a, 6) AS slope FROM w WHERE i = 100
""")
def gradient_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, a = iterate.gradient_descent(table(spark, sf_dir, "lineitem"), ["l_discount"], "l_tax", 0.1, 100)
    return spark.createDataFrame([(round(b, 6), round(a, 6))], "intercept double, slope double")


@query()
def rf_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of forests on shards of the embeddings, by majority vote on the rows held out."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", (F.col("label") % 2).cast("double"))
    train, test = ml.split(rows, "vec_id", 0.8)
    return ml.forest_votes(train, test, "vec_id", "embedding", "label").agg(F.avg((F.col("vote") == F.col("label")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


@query("SELECT o_custkey, round_even(avg((o_totalprice > 150000)::INTEGER), 0)::INTEGER AS vote FROM orders GROUP BY o_custkey")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import majority

    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(majority(F.avg((F.col("o_totalprice") > 150000).cast("double"))).alias("vote"))


@query("""
WITH m AS (SELECT avg(l_quantity * l_quantity) AS a, avg(l_quantity * l_extendedprice / 1000) AS b, avg(l_extendedprice * l_extendedprice / 1000000) AS c FROM lineitem)
SELECT round((a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / (a + c - sqrt((a - c) * (a - c) + 4 * b * b)), 4) AS condition_number FROM m
""")
def covariance_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition of the second moments of two columns, whose eigenvalues have a closed form."""
    number = leastsq.condition(table(spark, sf_dir, "lineitem"), ["l_quantity", F.col("l_extendedprice") / 1000.0]) ** 2
    return spark.createDataFrame([(round(number, 4),)], "condition_number double")


@query("SELECT s.range AS system, i.range AS i, 0.5 * (i.range + 1) * (40 - i.range) AS x FROM range(3) s CROSS JOIN range(40) i")
def tridiagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """-x[i-1] + 2 x[i] - x[i+1] = 1, whose solution is a parabola."""
    rows = spark.range(120).select(F.floor(F.col("id") / 40).alias("system"), (F.col("id") % 40).alias("i"), F.lit(-1.0).alias("a"), F.lit(2.0).alias("b"), F.lit(-1.0).alias("c"), F.lit(1.0).alias("d"))
    return linalg.solve_tridiagonal(rows).select("system", "i", F.round("x", 6).alias("x"))


_ENTRY = "CASE WHEN j = i THEN 10e0 ELSE ((s * 7 + i * 3 + j) % 5) / 10e0 END"


@query(f"""
WITH RECURSIVE x AS (SELECT range AS s, 0 AS step, list_transform(range(12), lambda i: 0e0) AS x FROM range(25)
  UNION ALL SELECT s, step + 1, list_transform(range(12), lambda i: (i + 1 - list_sum(list_transform(range(12), lambda j: CASE WHEN j = i THEN 0e0 ELSE {_ENTRY} * x[j + 1] END))) / 10) FROM x WHERE step < 60)
SELECT s AS system, i, round(x[i + 1], 6) AS x FROM (SELECT s, x, unnest(range(12)) AS i FROM x WHERE step = 60)
""")
def dense_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small dense systems with a dominant diagonal; the twin iterates to the same solutions."""
    n = 12
    row = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.when(j == F.col("i"), F.lit(10.0)).otherwise(F.pmod(F.col("system") * 7 + F.col("i") * 3 + j, F.lit(5)) / 10.0))
    rows = spark.range(25 * n).select(F.floor(F.col("id") / n).alias("system"), (F.col("id") % n).alias("i")).select("system", "i", row.alias("row"), (F.col("i") + 1.0).alias("d"))
    return linalg.solve_dense(rows).select("system", "i", F.round("x", 6).alias("x"))
