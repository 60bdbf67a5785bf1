"""Queries of aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..functions import scalar as S
from ..session import table
from ._registry import query


@query("""
SELECT l_returnflag, round(sum(l_quantity * l_quantity), 6) AS squares, round(sum(l_quantity * l_linenumber), 6) AS dot,
       round(sum(sqrt(l_quantity)), 4) AS roots, sum(l_quantity)::BIGINT AS total, max(l_quantity) AS high FROM lineitem GROUP BY l_returnflag
""")
def sum_sq_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(A.sum_of_squares(q), 6).alias("squares"),
        F.round(F.sum(q * F.col("l_linenumber")), 6).alias("dot"),
        F.round(F.sum(F.sqrt(q)), 4).alias("roots"),
        F.sum(q).cast("long").alias("total"),
        F.max(q).alias("high"),
    )


@query("SELECT l_linestatus, round(sum(l_quantity * l_quantity) + avg(l_quantity * l_quantity * l_quantity) - stddev_pop(l_quantity), 4) AS composite FROM lineitem GROUP BY l_linestatus")
def composite_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(A.composite(F.col("l_quantity")), 4).alias("composite"))


@query("""
SELECT l_orderkey, coalesce(round(avg(l_quantity), 6), 0) AS mean, CASE WHEN count(*) < 2 THEN 0 ELSE round(stddev_samp(l_quantity), 6) END AS std, count(*) AS n
FROM lineitem GROUP BY l_orderkey
""")
def sample_std_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(A.safe_mean(q), 6).alias("mean"), F.round(A.safe_sample_std(q), 6).alias("std"), F.count("*").alias("n"))


@query("SELECT (floor(p_size / 10) * 10)::BIGINT AS decade, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1")
def group_mean_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(S.decade(F.col("p_size")).alias("decade")).agg(F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("""
SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, round(min(c_acctbal), 6) AS low,
       round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(quantile_cont(c_acctbal, 0.5), 6) AS q2, round(quantile_cont(c_acctbal, 0.75), 6) AS q3, round(max(c_acctbal), 6) AS high
FROM customer GROUP BY c_mktsegment
""")
def describe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.describe(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")
    return found.select("c_mktsegment", "n", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


@query("""
WITH w AS (SELECT event_type, value, 1.0 / (1 + user_id % 3) AS w, least(greatest(trunc((value / 7 - floor(value / 7)) * 20), 0), 19)::INTEGER AS bin FROM events),
m AS (SELECT event_type, sum(w) AS sw, sum(w * value) / sum(w) AS mean FROM w GROUP BY event_type),
b AS (SELECT w.event_type, bin, sum(w.w / sw * (value - mean)) AS s, sum(w.w / sw) AS r FROM w JOIN m USING (event_type) GROUP BY w.event_type, bin)
SELECT m.event_type, g.range::INTEGER AS bin, round(coalesce(s, 0), 6) + 0.0 AS s, round(coalesce(r, 0), 6) AS r
FROM m CROSS JOIN range(20) g LEFT JOIN b ON b.event_type = m.event_type AND b.bin = g.range
""")
def weighted_phase_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that sum to one, the weighted mean taken off, sums by phase bin with empty bins as zeros."""
    rows = table(spark, sf_dir, "events").withColumn("w", F.lit(1.0) / (F.lit(1) + F.col("user_id") % 3)).withColumn("bin", S.phase_bin(F.col("value"), 7.0, 20))
    means = rows.groupBy("event_type").agg(F.sum("w").alias("sw"), (F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"))
    found = A.weighted_bins(rows.join(means, "event_type"), ["event_type"], "bin", 20, F.col("value") - F.col("mean"), F.col("w") / F.col("sw"))
    return found.select("event_type", "bin", (F.round("s", 6) + 0.0).alias("s"), F.round("r", 6).alias("r"))


@query("""
WITH b AS (SELECT least(floor(l_quantity / 2.5), 19)::INTEGER AS bin FROM lineitem WHERE l_quantity BETWEEN 0 AND 50)
SELECT g.range::INTEGER AS bin, count(b.bin) AS n FROM range(20) g LEFT JOIN b ON b.bin = g.range GROUP BY 1
""")
def histogram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [2.5 * i for i in range(21)])


_DAYS = "CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT)"
_CALENDAR = f"""
d AS (SELECT o_custkey % 4 AS cell, {_DAYS} // 365 AS year, {_DAYS} % 365 AS doy, o_totalprice AS t FROM orders),
spread AS (SELECT cell, (doy + o.range - 2 + 365) % 365 AS doy, t FROM d CROSS JOIN range(5) o),
thr AS (SELECT cell, doy, quantile_cont(t, 0.9) AS threshold FROM spread GROUP BY cell, doy)"""


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("cell"), S.year_of(day).cast("long").alias("year"), S.day_of_year(day).cast("long").alias("doy"), F.col("o_totalprice").alias("t"))


@query(f"WITH {_CALENDAR} SELECT cell, doy, round(threshold, 6) AS threshold FROM thr")
def calendar_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.circular_percentile(_calendar(spark, sf_dir), ["cell"], "doy", "t", 0.9)
    return found.select("cell", "doy", F.round("threshold", 6).alias("threshold"))


@query(f"""
WITH {_CALENDAR}, days AS (SELECT cell, year, doy, avg(t) AS t FROM d GROUP BY cell, year, doy)
SELECT cell, year, round(count(*) FILTER (WHERE t > threshold + 0.001) / 365.0, 6) AS above FROM days JOIN thr USING (cell, doy) GROUP BY cell, year
""")
def above_threshold_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calendar(spark, sf_dir)
    days = rows.groupBy("cell", "year", "doy").agg(F.avg("t").alias("t"))
    joined = days.join(A.circular_percentile(rows, ["cell"], "doy", "t", 0.9), ["cell", "doy"])
    return joined.groupBy("cell", "year").agg(F.round(F.count_if(F.col("t") > F.col("threshold") + 0.001) / 365.0, 6).alias("above"))


@query(f"WITH {_CALENDAR} SELECT cell, year, round(sum(greatest(t - 283.15, 0)), 2) AS degree_days, round(avg(t), 4) AS normal FROM d GROUP BY cell, year")
def degree_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _calendar(spark, sf_dir)
    return rows.groupBy("cell", "year").agg(F.round(F.sum(S.positive_part(F.col("t"), 283.15)), 2).alias("degree_days"), F.round(F.avg("t"), 4).alias("normal"))


@query("""
WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS median, max(value) AS high FROM events GROUP BY event_type),
a AS (SELECT event_type, quantile_cont(abs(value - median), 0.5) AS mad, any_value(median) AS median, any_value(high) AS high FROM events JOIN m USING (event_type) GROUP BY event_type)
SELECT event_type, round(median, 6) AS median, round(mad, 6) AS mad, round(CASE WHEN mad <= 0 THEN 0 ELSE (high - median) / (1.4826 * mad) END, 6) AS sde FROM a
""")
def median_mad_sde(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.median_mad(table(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "mad", "sde")])


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity FROM
  (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def argmax_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = A.first_max(F.struct("l_orderkey", "l_linenumber", "l_quantity"), F.col("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(best.alias("b")).select("l_suppkey", "b.*")


@query("""
SELECT toxic, count(*) FILTER (WHERE n_chars > 2000 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars > 2000 AND quality <> 1) AS fp,
       count(*) FILTER (WHERE n_chars <= 2000 AND quality = 1) AS fn, count(*) FILTER (WHERE n_chars <= 2000 AND quality <> 1) AS tn,
       round(avg(((n_chars > 2000) = (quality = 1))::INTEGER), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY toxic
""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    guess, truth = F.col("n_chars") > 2000, F.col("quality") == 1
    return rows.groupBy("toxic").agg(*A.confusion(guess, truth), F.round(A.share(guess == truth), 6).alias("accuracy"))


@query("""
SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg((abs(l_quantity - 25) <= 10)::INTEGER), 6) AS near,
       round(avg((l_discount - l_tax) * (l_discount - l_tax)), 6) AS mse, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY l_returnflag
""")
def corr_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"),
        F.round(A.share(F.abs(q - 25) <= 10), 6).alias("near"),
        F.round(A.mean_squared_error(F.col("l_discount"), F.col("l_tax")), 6).alias("mse"),
        F.round(A.variation(q), 6).alias("cv"),
    )


@query(f"SELECT id % 10 AS trial, round(4.0 * avg((x * x + y * y <= 1)::INTEGER), 9) AS pi FROM (SELECT range AS id, {S.uniform_sql(0, 'range')} AS x, {S.uniform_sql(1, 'range')} AS y FROM range(1000000)) GROUP BY 1")
def monte_carlo_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.monte_carlo_pi(spark, 10, 100_000).select("trial", F.round("pi", 9).alias("pi"))


@query(f"SELECT round(avg(x * x), 9) AS integral FROM (SELECT {S.uniform_sql(0, 'range')} AS x FROM range(1000000))")
def monte_carlo_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integral of x^2 over [0, 1]."""
    return A.monte_carlo_mean(spark, lambda x: x * x, 0.0, 1.0, 1_000_000).select(F.round("integral", 9).alias("integral"))


@query("""
SELECT user_id % 8 AS rank, greatest(ceil(event_id / 10.0) - 1, 0)::BIGINT % 50 AS tick, event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2, 3
""")
def profile_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric averages by count-based tick: the first tick has eleven calls, later ones ten."""
    tick = F.greatest(F.ceil(F.col("event_id") / 10.0) - 1, F.lit(0)).cast("long") % 50
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("rank"), tick.alias("tick"), "event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.count("*").alias("n"))


@query("""
SELECT l_returnflag, round(max(abs(l_discount - l_tax)) / greatest(max(abs(l_tax)), 1e-12), 6) AS max_error,
       round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))) / greatest(max(abs(l_tax)), 1e-12), 6) AS rms_error FROM lineitem GROUP BY l_returnflag
""")
def field_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*A.field_error(F.col("l_discount"), F.col("l_tax")))
    return found.select("l_returnflag", F.round("max_error", 6).alias("max_error"), F.round("rms_error", 6).alias("rms_error"))


@query("""
WITH c AS (SELECT l_suppkey AS k, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, round(s_acctbal + coalesce(q, 0), 6) AS s_acctbal FROM supplier LEFT JOIN c ON s_suppkey = k
""")
def scatter_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    adds = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_quantity").alias("s_acctbal"))
    found = A.scatter_add(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), adds, "s_suppkey", "s_acctbal")
    return found.select("s_suppkey", F.round("s_acctbal", 6).alias("s_acctbal"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_rows(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("SELECT coalesce(n_regionkey, -1) AS n_regionkey, coalesce(n_nationkey, -1) AS n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "customer").select("c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    found = rows.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))
    return found.select(*[F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_regionkey", "n_nationkey")], "n")


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, true AS orders_near, true AS parts_near, true AS median_near FROM lineitem GROUP BY 1")
def approximate_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches where exactness isn't asked for: distinct counts and quantiles in bounded memory, held against the exact ones."""
    near = lambda a, b: F.abs(a - b) <= 0.1 * b + 1
    found = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_orderkey").alias("a_orders"),
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("a_parts"),
        F.percentile_approx("l_quantity", 0.5).alias("a_median"),
        F.count_distinct("l_orderkey").alias("orders"),
        F.count_distinct("l_partkey").alias("parts"),
        F.percentile("l_quantity", 0.5).alias("median"),
    )
    flags = [near(F.col(f"a_{c}"), F.col(c)).alias(f"{c}_near") for c in ("orders", "parts", "median")]
    return found.select("l_returnflag", "orders", "parts", *flags)
