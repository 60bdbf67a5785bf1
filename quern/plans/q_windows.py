"""Queries of windows, order and stencils."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, stencil, windows
from ..session import table
from ._registry import query

_T = "epoch_us(ts) / 86400000000.0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0)


@query(f"""
SELECT event_id, round(quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY {_T} RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING), 6) AS trend FROM events
""")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_median(_events(spark, sf_dir), ["user_id"], "t", "value", 0.25).select("event_id", F.round("trend", 6).alias("trend"))


@query("SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS mean FROM events")
def prefix_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.prefix_mean(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value")
    return found.select("user_id", "event_id", F.round("mean", 9).alias("mean"))


_DAYS = """
o AS (SELECT o_custkey % 6 AS cell, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS d, avg(o_totalprice) AS t FROM orders GROUP BY 1, 2),
y AS (SELECT cell, d // 365 AS year, d % 365 AS doy, t FROM o)"""
_RUNS = """r AS (SELECT cell, year, count(*) AS n FROM (SELECT cell, year, doy - row_number() OVER (PARTITION BY cell, year ORDER BY doy) AS g FROM y WHERE {}) GROUP BY cell, year, g)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 6).alias("cell"), day.alias("d")).agg(F.avg("o_totalprice").alias("t"))
    return rows.select("cell", F.expr("d div 365").alias("year"), (F.col("d") % 365).alias("doy"), "t")


@query(f"WITH {_DAYS}, {_RUNS.format('t > 100000.005')} SELECT k.cell, k.year, coalesce(sum(n) FILTER (WHERE n >= 3), 0)::BIGINT AS days FROM (SELECT DISTINCT cell, year FROM y) k LEFT JOIN r USING (cell, year) GROUP BY 1, 2")
def run_length_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.run_length_sum(_days(spark, sf_dir), ["cell", "year"], "doy", F.col("t") > 100000.005, 3)


@query(f"WITH {_DAYS}, {_RUNS.format('t < 180000.005')} SELECT k.cell, k.year, coalesce(max(n), 0)::BIGINT AS days FROM (SELECT DISTINCT cell, year FROM y) k LEFT JOIN r USING (cell, year) GROUP BY 1, 2")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.longest_run(_days(spark, sf_dir), ["cell", "year"], "doy", F.col("t") < 180000.005)


@query("""
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM events
""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.moving_average(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", 5).select("event_id", F.round("smooth", 6).alias("smooth"))


_BINS = "b AS (SELECT (event_id % 40)::INTEGER AS bin, sum(user_id)::DOUBLE AS s, count(*)::DOUBLE AS r FROM events GROUP BY 1)"


@query(f"""
WITH {_BINS}, d AS (SELECT bin, s, r FROM b UNION ALL SELECT bin + 40, s, r FROM b),
g AS (SELECT b.bin AS start, w.width FROM b CROSS JOIN (VALUES (2), (3), (5)) w(width))
SELECT start, width, sum(s) AS s, sum(r) AS r FROM g JOIN d ON d.bin >= start AND d.bin < start + width GROUP BY 1, 2
""")
def circular_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 40).cast("int").alias("bin")).agg(F.sum("user_id").cast("double").alias("s"), F.count("*").cast("double").alias("r"))
    return windows.circular_blocks(binned, [], 40, (2, 3, 5))


@query("""
SELECT c_custkey, position, CASE WHEN position < (total % 70) * (total // 70 + 1) THEN position // (total // 70 + 1) ELSE total % 70 + (position - (total % 70) * (total // 70 + 1)) // (total // 70) END AS batch
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS position, count(*) OVER () AS total FROM customer)
""")
def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.batches(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 70, "c_acctbal", "c_custkey").select("c_custkey", "position", "batch")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.top_k(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), F.asc("o_orderkey"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INTEGER AS rank FROM lineitem) WHERE rank <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.top_k_per(table(spark, sf_dir, "lineitem"), ["l_suppkey"], 3, F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"))
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


def _morton_sql(bits: int) -> str:
    cells = ("(c_custkey % 1024)", "(c_custkey // 3 % 1024)")
    return " + ".join(f"(({c} >> {b}) & 1) * {1 << (2 * b + i)}" for b in range(bits) for i, c in enumerate(cells))


@query(f"SELECT c_custkey, ({_morton_sql(10)})::BIGINT AS code FROM customer")
def locality_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in ranges of their Morton code, sorted within: neighbours share files."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", relational.morton(k % 1024 / 1024, F.floor(k / 3) % 1024 / 1024).alias("code"))
    return rows.repartitionByRange("code").sortWithinPartitions("code", "c_custkey")


_GRID = "g AS (SELECT r.range AS r, c.range AS c, ((r.range * 37 + c.range * 17) % 101)::DOUBLE AS v FROM range(30) r CROSS JOIN range(20) c)"


def _grid(spark: SparkSession) -> DataFrame:
    r, c = F.floor(F.col("id") / 20), F.col("id") % 20
    return spark.range(600).select(r.alias("r"), c.alias("c"), ((r * 37 + c * 17) % 101).cast("double").alias("v"))


def _laplace_sql(source: str, boundary: float = 0.0) -> str:
    sides = " + ".join(f"coalesce({n}.v, {boundary})" for n in "nswe")
    joins = " ".join(f"LEFT JOIN {source} {n} ON {n}.r = g.r + {dr} AND {n}.c = g.c + {dc}" for n, dr, dc in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1)))
    return f"SELECT g.r, g.c, g.v AS u, {sides} - 4 * g.v AS l FROM {source} g {joins}"


@query(f"WITH {_GRID} SELECT r, c, l AS v FROM ({_laplace_sql('g')})")
def laplace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.laplacian(_grid(spark))


@query(f"WITH {_GRID} SELECT (r + 3) % 30 AS r, (c + 20 - 2) % 20 AS c, v FROM g")
def roll_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.roll(_grid(spark), 3, -2, (30, 20))


@query(f"""
WITH {_GRID}, s AS (SELECT a.r, a.c, sum(b.v) / 5 AS v FROM g a JOIN (VALUES (0, 0), (1, 0), (29, 0), (0, 1), (0, 19)) o(dr, dc) ON true
  JOIN g b ON b.r = (a.r + dr) % 30 AND b.c = (a.c + dc) % 20 GROUP BY 1, 2)
SELECT r, c, round(v, 6) AS v FROM s
""")
def smooth_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.smooth(_grid(spark), (30, 20), 1).select("r", "c", F.round("v", 6).alias("v"))


def _heat_sql(steps: int) -> str:
    parts = [f"WITH {_GRID.replace('g AS', 'h0 AS', 1)}"]
    for i in range(steps):
        parts.append(f"h{i + 1} AS (SELECT r, c, u + 0.1 * l AS v FROM ({_laplace_sql(f'h{i}', 5.0)}))")
    return ", ".join(parts) + f" SELECT r, c, round(v, 6) AS v FROM h{steps}"


@query(_heat_sql(4))
def heat_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.iterate import repeat

    found = repeat(_grid(spark), lambda g: stencil.heat_step(g, 0.1, 5.0, (30, 20)), 4, every=2)
    return found.select("r", "c", F.round("v", 6).alias("v"))


@query("""
SELECT user_id, event_id, (rank() OVER w)::BIGINT AS rank, (dense_rank() OVER w)::BIGINT AS dense, (ntile(4) OVER w)::BIGINT AS quarter,
       round(coalesce(value - lag(value) OVER w, 0), 6) AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def ranking_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.rank().over(w).cast("long").alias("rank"),
        F.dense_rank().over(w).cast("long").alias("dense"),
        F.ntile(4).over(w).cast("long").alias("quarter"),
        F.round(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), 6).alias("change"),
    )
