"""Queries of element-wise maps and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import pairwise
from ..session import table
from ._registry import query


@query("""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v)
SELECT a.label AS label_a, b.label AS label_b, count(*) AS pairs, round(avg(list_distance(a.e, b.e)), 6) AS mean_distance,
       round(stddev_pop(list_distance(a.e, b.e)), 6) AS std_distance, round(min(list_distance(a.e, b.e)), 6) AS min_distance,
       round(max(list_distance(a.e, b.e)), 6) AS max_distance
FROM n a JOIN n b ON a.vec_id < b.vec_id GROUP BY a.label, b.label
""")
def pairwise_distance_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of unit vectors, in blocks, by label pair."""
    return pairwise.distance_stats(table(spark, sf_dir, "embeddings"))


@query("""
SELECT l_orderkey, l_linenumber, round(exp(l_discount) + sin(l_discount), 6) AS exp_sin,
       round(sin(l_tax) * cos(l_tax * l_tax) + exp(-(l_tax * l_tax)), 6) AS wave,
       round(sin(l_tax) * exp(-(l_tax * l_tax)), 6) AS damped, round(sqrt(l_quantity * l_quantity + 1), 6) AS root,
       round((l_quantity + 3) * l_quantity + 2, 6) AS quadratic, round(2 * l_quantity + 3, 6) AS slope, round(sin(l_tax) * sin(l_tax), 6) AS sine2,
       round(tan(pow(l_tax, l_tax)) + sqrt(pow(l_tax, l_tax)) + acos(sin(l_tax) * cos(l_tax) * exp(-l_tax)), 6) AS chain
FROM lineitem
""")
def elementwise_trig(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, coefficients = F.col("l_quantity"), (1.0, 3.0, 2.0)
    rounded = {
        "exp_sin": S.exp_plus_sin(F.col("l_discount")),
        "wave": S.wave(F.col("l_tax")),
        "damped": S.damped_sine(F.col("l_tax")),
        "root": S.root_square_plus_one(q),
        "quadratic": S.polynomial(q, coefficients),
        "slope": S.polynomial(q, S.polynomial_derivative(coefficients)),
        "sine2": S.sine_squared(F.col("l_tax")),
        "chain": S.fused_chain(F.col("l_tax")),
    }
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in rounded.items()])


@query("""
SELECT event_id, round(CASE WHEN value > 0.5 THEN value * value ELSE 0.0 END, 6) AS squared,
       round(value * 2, 6) AS doubled, round(value + 10, 6) AS shifted, round((value - 1) * (value - 1), 6) AS error FROM events
""")
def conditional_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    columns = {"squared": S.square_above(v, 0.5), "doubled": S.scale(v, 2.0), "shifted": S.shift(v, 10.0), "error": S.squared_error(v, F.lit(1.0))}
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(n) for n, c in columns.items()])


@query("""
SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS hypot,
       round(1 / (1 + exp(-l_discount)), 6) AS sigmoid, round(l_quantity * 2 + l_tax, 6) AS axpy FROM lineitem
""")
def sigmoid_hypot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("l_quantity"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(S.hypotenuse(q, t), 6).alias("hypot"), F.round(S.sigmoid(F.col("l_discount")), 6).alias("sigmoid"), F.round(S.axpy(q, t), 6).alias("axpy")
    )


@query("""
SELECT l_orderkey, l_linenumber, round(abs(l_quantity - 25) + abs(l_discount - 0.05), 6) AS manhattan,
       round(sqrt((l_quantity - 25) * (l_quantity - 25) + (l_discount - 0.05) * (l_discount - 0.05)), 6) AS euclid FROM lineitem
""")
def distance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = (F.col("l_quantity"), F.col("l_discount"), F.lit(25.0), F.lit(0.05))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.manhattan(*point), 6).alias("manhattan"), F.round(S.euclidean(*point), 6).alias("euclid"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity::SMALLINT::INTEGER AS as_short, l_quantity::BIGINT AS as_long,
       round((l_discount::FLOAT)::DOUBLE, 6) AS through_float FROM lineitem
""")
def cast_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", q.cast("smallint").cast("int").alias("as_short"), q.cast("long").alias("as_long"), F.round(F.col("l_discount").cast("float").cast("double"), 6).alias("through_float")
    )


@query("""
SELECT (floor(p_size / 10) * 10)::BIGINT AS decade, count(*) AS n, round(avg(p_retailprice / 1000), 6) AS mean_thousands,
       count(*) FILTER (WHERE p_size > 25) AS above FROM part GROUP BY 1
""")
def derived_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("thousands", F.col("p_retailprice") / 1000).withColumn("decade", S.decade(F.col("p_size")))
    return parts.groupBy("decade").agg(F.count("*").alias("n"), F.round(F.avg("thousands"), 6).alias("mean_thousands"), F.count_if(F.col("p_size") > 25).alias("above"))


@query("""
SELECT c_custkey, round(cos(radians(c_acctbal / 200)) * cos(radians(c_custkey % 360)), 6) + 0.0 AS x,
       round(cos(radians(c_acctbal / 200)) * sin(radians(c_custkey % 360)), 6) + 0.0 AS y, round(sin(radians(c_acctbal / 200)), 6) + 0.0 AS z FROM customer
""")
def sky_to_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = S.unit_sphere(F.col("c_custkey") % 360, F.col("c_acctbal") / 200)
    return table(spark, sf_dir, "customer").select("c_custkey", *[(F.round(c, 6) + 0.0).alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])  # no negative zeros


@query("""
SELECT l_orderkey, l_linenumber, round(l_quantity - 7.5 * round_even(l_quantity / 7.5, 0), 6) AS image,
       round(least(greatest(l_quantity, 10), 40), 6) AS clipped, round(greatest(l_quantity - 20, 0), 6) AS positive FROM lineitem
""")
def min_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    columns = {"image": S.minimum_image(q, 7.5), "clipped": S.clip(q, 10.0, 40.0), "positive": S.positive_part(q, 20.0)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in columns.items()])


@query("""
SELECT event_id, least(greatest(trunc((value / 3.5 - floor(value / 3.5)) * 200), 0), 199)::INTEGER AS bin FROM events
""")
def phase_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", S.phase_bin(F.col("value"), 3.5, 200).alias("bin"))


@query("""
WITH k AS (SELECT range::INTEGER AS k FROM range(144)),
named AS (SELECT k, (k // 24 + 1)::VARCHAR || '-' || (k // 4 % 6 + 1)::VARCHAR AS ccd FROM k)
SELECT k, ccd || '.' || substr('EFGH', k % 4 + 1, 1) AS name, k AS number, ccd AS ccd, k // 4 AS ccd_number FROM named
""")
def detector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.range(144).select(F.col("id").cast("int").alias("k"))
    named = k.select("k", S.quadrant_name(F.col("k")).alias("name"), S.ccd_name(F.floor(F.col("k") / 4).cast("int")).alias("ccd"))
    return named.select("k", "name", S.detector_number(F.col("name")).cast("int").alias("number"), "ccd", S.detector_number(F.col("ccd")).cast("int").alias("ccd_number"))


@query("""
SELECT a.r_regionkey AS i, b.n_nationkey AS j, a.r_regionkey * b.n_nationkey AS product,
       (a.r_regionkey * 25 + b.n_nationkey)::BIGINT AS flat FROM region a CROSS JOIN nation b
""")
def outer_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two index relations of fixed size, broadcast against each other."""
    i, j = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("i")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("j"))
    return i.crossJoin(F.broadcast(j)).select("i", "j", (F.col("i") * F.col("j")).alias("product"), S.flat_index(F.col("i"), F.col("j"), 25).alias("flat"))


@query("""
SELECT l_linenumber::BIGINT AS i, l_orderkey AS j, l_orderkey * 7 + l_linenumber AS flat, (l_orderkey * 7 + l_linenumber) // 7 AS row, (l_orderkey * 7 + l_linenumber) % 7 AS col FROM lineitem
""")
def transpose_ravel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transpose is a projection; ravel and reshape are index arithmetic."""
    flat = S.flat_index(F.col("l_orderkey"), F.col("l_linenumber"), 7)
    row, col = S.unflatten(flat, 7)
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("i"), F.col("l_orderkey").alias("j"), flat.alias("flat"), row.alias("row"), col.alias("col"))


@query("SELECT event_id, event_id % 3 AS part, value FROM events WHERE event_id % 3 IN (0, 1)")
def strided_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two interleaved slices, data[0::3] and data[1::3], each for a consumer of its own."""
    events = table(spark, sf_dir, "events")
    one = lambda k: events.where(F.col("event_id") % 3 == k).select("event_id", F.lit(k).cast("long").alias("part"), "value")
    return one(0).unionByName(one(1))


@query("""
SELECT n_nationkey, CASE WHEN length(n_name) < 8 THEN rpad(n_name, 8, ' ') ELSE n_name END AS padded,
       CASE WHEN n_nationkey % 2 = 0 THEN n_name || '.' || n_regionkey ELSE n_name END AS name, 'read' || lpad(n_nationkey::VARCHAR, 6, '0') AS read FROM nation
""")
def header_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    quadrant = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey").cast("string"))
    header = F.map_filter(F.create_map(F.lit("CCDID"), F.col("n_name"), F.lit("QUADID"), quadrant), lambda k, v: v.isNotNull())
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", S.padded_header(header)["CCDID"].alias("padded"), S.header_name(header).alias("name"), F.concat(F.lit("read"), F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).alias("read")
    )


@query("""
WITH n AS (SELECT range AS n FROM range(2, 5000))
SELECT count(*) AS primes FROM n WHERE NOT EXISTS (SELECT 1 FROM range(2, 71) d WHERE d.range * d.range <= n.n AND n.n % d.range = 0)
""")
def prime_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(5000).where(S.is_prime(F.col("id"))).agg(F.count("*").alias("primes"))


@query("""
WITH RECURSIVE p AS (SELECT x.range AS x, y.range AS y, -2 + 3.0::DOUBLE * x.range / 40 AS cx, -1.5 + 3.0::DOUBLE * y.range / 30 AS cy FROM range(40) x, range(30) y),
z AS (
  SELECT x, y, cx, cy, 0 AS n, cx AS re, cy AS im, cx * cx + cy * cy > 4 AS out FROM p
  UNION ALL
  SELECT x, y, cx, cy, n + 1, re * re - im * im + cx, re * im * 2 + cy,
         (re * re - im * im + cx) * (re * re - im * im + cx) + (re * im * 2 + cy) * (re * im * 2 + cy) > 4
  FROM z WHERE NOT out AND n < 29)
SELECT x, y, max(n)::INTEGER AS steps FROM z GROUP BY x, y
""")
def mandelbrot(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(40 * 30).select((F.col("id") % 40).alias("x"), F.floor(F.col("id") / 40).alias("y"))
    return grid.select("x", "y", S.escape_step(F.lit(-2.0) + F.lit(3.0) * F.col("x") / 40, F.lit(-1.5) + F.lit(3.0) * F.col("y") / 30, 30).alias("steps"))


@query("SELECT o_orderstatus, max(o_totalprice) AS max_price FROM orders WHERE NOT (o_orderpriority = '1-URGENT') GROUP BY o_orderstatus")
def cancel_filter_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where(~(F.col("o_orderpriority") == "1-URGENT"))
    return orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("max_price"))


@query("""
SELECT event_id, user_id, length(event_type) AS n, upper(event_type) AS upper, props, json_extract_string(props, '$.' || (json_keys(props))[1]) IS NOT NULL AS has_value FROM events
""")
def string_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.get(F.map_keys(F.from_json("props", "map<string,string>")), F.lit(0))
    value = F.try_element_at(F.from_json("props", "map<string,string>"), first)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.length("event_type").cast("long").alias("n"), F.upper("event_type").alias("upper"), "props", value.isNotNull().alias("has_value"))
