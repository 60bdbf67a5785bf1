"""Queries of joins, set operations and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linalg, pairwise, relational, spatial
from ..operators.checkpoints import use_checkpoints
from ..session import table
from ._registry import query


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    found = relational.lookup(relational.lookup(orders, customer, ["c_custkey"], strict=True), table(spark, sf_dir, "nation"), ["n_nationkey"])
    return found.select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.missing_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 150000").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


_SIDES = """
a AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT l_partkey AS k, sum(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)"""


def _sides(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity")
    return [items.where(F.col("l_returnflag") == f).groupBy("k").agg(F.sum("l_quantity").alias("v")) for f in "AR"]


@query(f"""
WITH {_SIDES}
SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, -1) AS base, coalesce(b.v, -1) AS candidate, coalesce(abs(a.v - b.v), -1) AS difference,
       CASE WHEN b.k IS NULL THEN 'no candidate' WHEN a.k IS NULL THEN 'no base' ELSE 'both' END AS found FROM a FULL JOIN b ON a.k = b.k
""")
def regression_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.compare_keyed(*_sides(spark, sf_dir), ["k"], "v")
    return found.select("k", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("base", "candidate", "difference")], "found")


@query("""
WITH c AS (SELECT vec_id AS k, list_transform(embedding, lambda x: x::DOUBLE) AS w FROM embeddings WHERE vec_id < 8),
d AS (SELECT e.vec_id, c.k, list_distance(list_transform(e.embedding, lambda x: x::DOUBLE), c.w) AS d FROM embeddings e CROSS JOIN c)
SELECT vec_id AS id, arg_min(k, {'d': d, 'k': k}) AS nearest, round(min(d), 6) AS distance FROM d GROUP BY vec_id
""")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    few = vectors.where("id < 8").select(F.col("id").alias("other_id"), F.col("v").alias("w"))  # eight centroids
    found = pairwise.nearest(vectors, few)
    return found.select("id", "nearest", F.round("distance", 6).alias("distance"))


_POINTS = """p AS (SELECT c_custkey AS id, c_nationkey % 5 AS frame, (c_custkey * 7919 % 1000) / 100.0::DOUBLE AS x,
  (c_custkey * 104729 % 997) / 100.0::DOUBLE AS y, (c_custkey * 1299709 % 991) / 100.0::DOUBLE AS z FROM customer)"""
_D2 = " + ".join(f"(a.{c} - b.{c} - 10 * round_even((a.{c} - b.{c}) / 10, 0)) * (a.{c} - b.{c} - 10 * round_even((a.{c} - b.{c}) / 10, 0))" for c in "xyz")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), (F.col("c_nationkey") % 5).alias("frame"), (k * 7919 % 1000 / 100.0).alias("x"), (k * 104729 % 997 / 100.0).alias("y"), (k * 1299709 % 991 / 100.0).alias("z")
    )


BOX = (10.0, 10.0, 10.0)


@query(f"WITH {_POINTS} SELECT a.frame, a.id AS a, b.id AS b, round({_D2}, 6) AS r2 FROM p a JOIN p b ON a.frame = b.frame AND a.id < b.id WHERE {_D2} <= 0.64")
def cell_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.close_pairs(_points(spark, sf_dir), BOX, 0.8, ("frame",))
    return found.select("frame", "a", "b", F.round("r2", 6).alias("r2"))


@query(f"""
WITH {_POINTS}, d AS (SELECT sqrt({_D2}) AS r FROM p a JOIN p b ON a.frame = b.frame AND a.id < b.id)
SELECT g.range::INTEGER AS bin, count(d.r) AS n FROM range(24) g LEFT JOIN d ON d.r <= 1.2 AND least(floor(d.r / 0.05), 23) = g.range GROUP BY 1
""")
def pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.pair_histogram(_points(spark, sf_dir), BOX, [0.05 * i for i in range(24)] + [1.2], ("frame",))


@query(f"""
WITH {_POINTS}, c AS (SELECT a.frame, a.id % 300 AS a, b.id % 300 AS b FROM p a JOIN p b ON a.frame = b.frame AND a.id < b.id WHERE {_D2} < 1.0),
u AS (SELECT DISTINCT frame, least(a, b) AS a, greatest(a, b) AS b FROM c), n AS (SELECT a, b FROM u WHERE frame = 0)
SELECT f.frame, round(coalesce(k, 0) / greatest((SELECT count(*) FROM n), 1), 6) AS q
FROM (SELECT DISTINCT frame FROM p) f LEFT JOIN (SELECT frame, count(*) AS k FROM u JOIN n USING (a, b) GROUP BY frame) k ON f.frame = k.frame
""")
def contact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    near = spatial.contacts(points, BOX, 1.0, ("frame",))
    folded = near.select("frame", F.least(F.col("a") % 300, F.col("b") % 300).alias("a"), F.greatest(F.col("a") % 300, F.col("b") % 300).alias("b")).distinct()
    use_checkpoints(spark)
    folded = folded.checkpoint()  # it is read twice, and the pairs are many
    return spatial.native_fraction(folded, points, "frame", 0).select("frame", F.round("q", 6).alias("q"))


@query(f"""
WITH {_POINTS}, d AS (SELECT a.frame, a.id AS a, b.id AS b, {_D2} AS r2 FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id WHERE {_D2} <= 1.0)
SELECT frame, a, b AS partner, round(r2, 6) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY frame, a ORDER BY r2, b) AS r FROM d) WHERE r = 1
""")
def nearest_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.nearest_partner(_points(spark, sf_dir), BOX, 1.0, ("frame",))
    return found.select("frame", "a", "partner", F.round("r2", 6).alias("r2"))


@query(f"WITH {_POINTS} SELECT a.id FROM p a WHERE a.frame = 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.frame = 0 AND {_D2} < 0.81)")
def clash_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    return spatial.without_clashes(points.where("frame = 1"), points.where("frame = 0"), BOX, 0.9).select("id")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_returnflag = 'R')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_quantity >= 50 and l_returnflag = 'R'")
    return table(spark, sf_dir, "supplier").join(items, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("""
WITH f AS (SELECT range::INTEGER AS det, (range % 12) * 80 AS x0, (range // 12) * 80 AS y0, 90 AS nx, 90 AS ny FROM range(144)),
p AS (SELECT o_orderkey AS id, (o_custkey * 37 % 1000)::DOUBLE AS x, (o_orderkey * 53 % 1000)::DOUBLE AS y FROM orders)
SELECT p.id, coalesce(min(det), -1) AS det FROM p LEFT JOIN f ON x - x0 > 5 AND x - x0 <= nx - 5 AND y - y0 > 5 AND y - y0 <= ny - 5 GROUP BY p.id
""")
def first_match_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("id")
    footprints = spark.range(144).select(k.cast("int").alias("det"), (k % 12 * 80).alias("x0"), (F.floor(k / 12) * 80).alias("y0"), F.lit(90).alias("nx"), F.lit(90).alias("ny"))
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 37 % 1000).cast("double").alias("x"), (F.col("o_orderkey") * 53 % 1000).cast("double").alias("y"))
    return spatial.first_footprint(points, footprints, "det", 5.0).select("id", F.coalesce("det", F.lit(-1)).alias("det"))


_A = "a AS (SELECT l_orderkey % 50 AS i, l_partkey % 40 AS k, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2)"
_B = "b AS (SELECT l_partkey % 40 AS k, l_suppkey % 30 AS j, sum(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf_dir: str, row: tuple[str, int, str], column: tuple[str, int, str], value: str) -> DataFrame:
    keys = [(F.col(c) % n).alias(name) for c, n, name in (row, column)]
    return table(spark, sf_dir, "lineitem").groupBy(*keys).agg(F.sum(value).cast("long").alias("v"))


def _a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, ("l_orderkey", 50, "i"), ("l_partkey", 40, "k"), "l_quantity")


def _b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, ("l_partkey", 40, "k"), ("l_suppkey", 30, "j"), "l_linenumber")


@query(f"WITH {_A}, x AS (SELECT range AS k, range % 7 AS v FROM range(40)) SELECT i, sum(a.v * x.v)::BIGINT AS v FROM a JOIN x USING (k) GROUP BY i")
def matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.matvec(_a(spark, sf_dir), spark.range(40).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")))


@query(f"WITH {_A}, {_B} SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b USING (k) GROUP BY i, j")
def matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    linalg.check_shapes(40, 40)
    return linalg.matmul(_a(spark, sf_dir), _b(spark, sf_dir))


@query(f"WITH {_A}, {_B} SELECT i, j, sum(a.v * b.v)::BIGINT AS v FROM a JOIN b USING (k) GROUP BY i, j")
def block_matmul(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linalg.block_matmul(_a(spark, sf_dir), _b(spark, sf_dir), (50, 40, 30), 16)
    return found.select("i", "j", F.col("v").cast("long").alias("v"))


@query("""
WITH r AS (SELECT l_orderkey AS id, l_linenumber AS f, l_quantity::BIGINT AS v FROM lineitem)
SELECT a.f AS f1, b.f AS f2, sum(a.v * b.v)::BIGINT AS v FROM r a JOIN r b USING (id) GROUP BY 1, 2
""")
def gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.gram(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("f"), F.col("l_quantity").cast("long").alias("v")))


@query("""
WITH a AS (SELECT l_orderkey % 30 AS i, l_suppkey % 30 AS j, sum(l_linenumber)::BIGINT AS v FROM lineitem GROUP BY 1, 2)
SELECT i, j, sum(v)::BIGINT AS v FROM (SELECT i, j, v FROM a UNION ALL SELECT j, i, v FROM a) GROUP BY i, j
""")
def transpose_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.transpose_sum(_matrix(spark, sf_dir, ("l_orderkey", 30, "i"), ("l_suppkey", 30, "j"), "l_linenumber"))


@query("""
WITH p AS (SELECT s_suppkey AS id, (s_suppkey * 7919 % 1000) / 10.0::DOUBLE AS x, (s_suppkey * 104729 % 997) / 10.0::DOUBLE AS y, (1 + s_suppkey % 5)::DOUBLE AS m FROM supplier),
d AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy, a.m * b.m AS mm, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + 0.0001) AS r FROM p a JOIN p b ON a.id <> b.id)
SELECT id, round(sum(mm / (r * r * r) * dx), 4) + 0.0 AS fx, round(sum(mm / (r * r * r) * dy), 4) + 0.0 AS fy FROM d GROUP BY id
""")
def nbody_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    particles = table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 7919 % 1000 / 10.0).alias("x"), (k * 104729 % 997 / 10.0).alias("y"), (1 + k % 5).cast("double").alias("m"))
    return linalg.gravity(particles).select("id", (F.round("fx", 4) + 0.0).alias("fx"), (F.round("fy", 4) + 0.0).alias("fy"))


@query("""
SELECT 'customer' AS provenance, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2
""")
def union_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"customer": table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), "supplier": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))}
    return relational.with_provenance(parts).groupBy("provenance", "nation").agg(F.count("*").alias("n"))


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey")))


@query("SELECT (n_nationkey + 1) % 25 AS rank, n_name AS received FROM nation")
def ring_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rank"), F.col("n_name").alias("received"))
    return relational.ring_shift(held, "rank", 25)


@query("SELECT s_suppkey % 8 AS rank, sum(s_suppkey)::BIGINT AS size, coalesce(sum(sum(s_suppkey)) OVER (ORDER BY s_suppkey % 8 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS displacement FROM supplier GROUP BY 1")
def gather_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 8).alias("rank"), F.col("s_suppkey").alias("size"))
    return relational.displacements(ranks, "rank", "size")


@query("""
SELECT event_id, user_id, round(value, 4) AS found, list_bool_or(list_transform([1, 2, 0.5, 3, 1.0 / 3], lambda k: abs(value - (user_id + 1) * k) <= 0.02 * (user_id + 1) * k)) AS matches FROM events
""")
def period_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    match = relational.alias_match(F.col("value"), (F.col("user_id") + 1).cast("double"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.round("value", 4).alias("found"), match.alias("matches"))
