"""Queries over sequences and groups that no task holds whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import banded, kdtree, leastsq, ranges, selection, similarity
from ..operators.checkpoints import shared_folder
from ..session import table
from ._registry import query


@query("""
SELECT event_id, round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda s, x: x / 3e0 + (1e0 - 1e0 / 3e0) * s), 6) AS smooth FROM events
""")
def exponential_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranges.exponential_smoothing(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), 1.0 / 3.0, "smooth")
    return found.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""
SELECT event_id, round(list_reduce(list(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), lambda s, x: 0.6e0 * s + 2e0 * x), 5) AS noise FROM (SELECT * FROM events WHERE event_type = 'view')
""")
def autoregressive_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recurrence over all views: a single series across all ranges."""
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    return ranges.autoregressive(views, [], ["ts", "event_id"], F.col("value"), 0.6, 2.0, "noise").select("event_id", F.round("noise", 5).alias("noise"))


#: The inverse of the system is a two-sided decay over the series and its mirror images at both ends.
_SPLINE = """
WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
near AS (SELECT e.event_id, o.range - 40 AS o, i + o.range - 40 AS j, n FROM e CROSS JOIN range(81) o)
SELECT near.event_id, round(sum(power(0.38196601125010515e0, abs(o)) * e.value) / sqrt(5e0), 6) AS smooth
FROM near JOIN e ON e.i = CASE WHEN j < 0 THEN -1 - j WHEN j >= near.n THEN 2 * near.n - 1 - j ELSE j END GROUP BY near.event_id
"""


@query(_SPLINE)
def smoothing_spline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in time as one tridiagonal system."""
    found = banded.smoothed(table(spark, sf_dir, "events"), [], ["ts", "event_id"], F.col("value"), 1.0, "smooth")
    return found.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, 2.5e0 + (event_id % 5) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
down AS (SELECT user_id, event_id, i, n, -1e0 / b AS s, d / b AS r FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.n, -1e0 / (e.b + down.s), (e.d + down.r) / (e.b + down.s) FROM down JOIN e ON e.user_id = down.user_id AND e.i = down.i + 1),
up AS (SELECT user_id, event_id, i, r AS x FROM down WHERE i = n
  UNION ALL SELECT d.user_id, d.event_id, d.i, d.r - d.s * up.x FROM up JOIN down d ON d.user_id = up.user_id AND d.i = up.i - 1)
SELECT user_id, event_id, round(x, 6) AS x FROM up
""")
def banded_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A system for each user, with a diagonal of its own; many systems share a range."""
    b, off = 2.5 + F.col("event_id") % 5, F.lit(-1.0)
    found = banded.solve_tridiagonal_ranges(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], (off, b, off, F.col("value")))
    return found.select("user_id", "event_id", F.round("x", 6).alias("x"))


_SHARES = (0.1, 0.5, 0.9)


@query(" UNION ALL ".join(f"SELECT l_returnflag, {p}::DOUBLE AS share, round(quantile_cont(l_extendedprice, {p}), 6) AS price FROM lineitem GROUP BY l_returnflag" for p in _SHARES))
def exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", _SHARES)
    return found.select("l_returnflag", "share", F.round("quantile", 6).alias("price"))


@query("""
WITH m AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(any_value(median), 6) AS median, round(quantile_cont(abs(l_extendedprice - median), 0.5), 6) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1
""")
def exact_median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.median_mad(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return found.select("l_returnflag", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


_TINY = 2.0**-28


@query("""
WITH m AS (SELECT l_quantity AS q, round(l_discount * 100) AS k, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT covar_pop(y, q) AS yq, covar_pop(y, k) AS yk, covar_pop(q, k) AS qk, var_pop(q) AS qq, var_pop(k) AS kk, avg(y) AS y, avg(q) AS q, avg(k) AS k FROM m),
b AS (SELECT (yq * kk - yk * qk) / (qq * kk - qk * qk) AS bq, (yk * qq - yq * qk) / (qq * kk - qk * qk) AS bk, y, q, k FROM c)
SELECT round(y - bq * q - bk * k, 3) AS intercept, round(bq, 2) AS together, round(bk, 4) AS apart FROM b
""")
def collinear_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price in thousands by two columns that differ by 4e-9 of the discount: their sum's weight, and their difference's.

    The condition number is about 1e10; the twin solves for quantity and discount, which are far apart.
    """
    items = table(spark, sf_dir, "lineitem").withColumn("close", F.col("l_quantity") + F.round(F.col("l_discount") * 100) * _TINY)
    intercept, one, other = leastsq.least_squares(items, ["l_quantity", "close"], F.col("l_extendedprice") / 1000)
    return spark.createDataFrame([(round(intercept, 3), round(one + other, 2), round(other * _TINY, 4))], "intercept double, together double, apart double")


def _cosine_sql(row: str, column: str, threshold: float) -> str:
    return f"""
WITH c AS (SELECT {row} AS i, {column} AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
u AS (SELECT i, k, v / sqrt(sum(v * v) OVER (PARTITION BY i)) AS v FROM c)
SELECT i, j, round(cosine, 6) AS cosine FROM (SELECT a.i, b.i AS j, sum(a.v * b.v) AS cosine FROM u a JOIN u b ON a.k = b.k AND a.i < b.i GROUP BY 1, 2) WHERE cosine >= {threshold}
"""


def _cells(spark: SparkSession, sf_dir: str, row: str, column: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col(row).alias("i"), F.col(column).alias("k"), F.col("l_quantity").alias("v"))


@query(_cosine_sql("l_partkey", "l_suppkey", 0.523456))
def similar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by how much each supplier delivers of them: a quarter of the cells are there, so prefixes are long."""
    found = similarity.similarity_join(_cells(spark, sf_dir, "l_partkey", "l_suppkey"), 0.523456, 0.25)
    return found.select("i", "j", F.round("cosine", 6).alias("cosine"))


@query(_cosine_sql("l_orderkey", "l_partkey", 0.723456))
def similar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by their parts, a few of very many."""
    found = similarity.similarity_join(_cells(spark, sf_dir, "l_orderkey", "l_partkey"), 0.723456)
    return found.select("i", "j", F.round("cosine", 6).alias("cosine"))


_DEPTH, _AXES = 4, ("x", "y", "z")


def _kd_sql(depth: int) -> str:
    wide = ", ".join(f"max({a}) OVER (PARTITION BY node) - min({a}) OVER (PARTITION BY node) AS w{a}" for a in _AXES)
    parts = ["WITH n0 AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 0 AS node FROM embeddings)"]
    for i in range(depth):
        value = "CASE WHEN wx >= wy AND wx >= wz THEN x WHEN wy >= wz THEN y ELSE z END"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY node ORDER BY {value}, vec_id) AS r, count(*) OVER (PARTITION BY node) AS n FROM (SELECT *, {wide} FROM n{i})"
        parts.append(f"n{i + 1} AS (SELECT vec_id, x, y, z, 2 * node + (r > (n + 1) // 2)::INT AS node FROM ({ranked}))")
    return ", ".join(parts)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(a) for i, a in enumerate(_AXES)])


@query(f"{_kd_sql(_DEPTH)} SELECT vec_id, node AS leaf FROM n{_DEPTH}")
def kd_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf of each vector in a tree over its first three coordinates."""
    points = _points(spark, sf_dir)
    return kdtree.build(points, "vec_id", _AXES, _DEPTH).place(points).select("vec_id", "leaf")


@query("SELECT vec_id FROM embeddings WHERE embedding[1] BETWEEN -0.05 AND 0.1 AND embedding[2] BETWEEN 0 AND 0.2 AND embedding[3] BETWEEN -0.1 AND 0.05")
def kd_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of the same space, read from the leaves that it meets."""
    points, path = _points(spark, sf_dir), f"{shared_folder(spark)}/kd-{uuid.uuid4().hex}"
    placed = kdtree.build(points, "vec_id", _AXES, _DEPTH).place(points)
    kdtree.write_leaves(placed, path)
    bounds = kdtree.boxes(spark.read.parquet(path), _AXES)
    return kdtree.read_box(spark, path, bounds, _AXES, (-0.05, 0.0, -0.1), (0.1, 0.2, 0.05)).select("vec_id")
