"""Queries of streams, run over what is available and returned as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import events as S
from ..streaming import frames, ticks
from ._registry import query


@query("""
SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.to_table(S.tumbling(S.event_stream(spark, sf_dir), "6 hours"), "complete")
    return found.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
SELECT epoch_us(time_bucket(INTERVAL '3 hours', ts) - to_hours(3 * o.range)) AS start_us, count(*) AS n FROM events CROSS JOIN range(4) o GROUP BY 1
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.to_table(S.sliding(S.event_stream(spark, sf_dir), "12 hours", "3 hours"), "complete")
    return found.select(F.unix_micros("w.start").alias("start_us"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.to_table(S.sessions(S.event_stream(spark, sf_dir), "4 hours"), "complete")
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY user_id, event_type")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.to_table(S.deduplicated(S.event_stream(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.to_table(S.running_histogram(S.event_stream(spark, sf_dir), F.floor(F.col("value") / 10)), "complete")


@query("""
WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS calls FROM events),
t AS (SELECT *, greatest(ceil(i / 10.0) - 1, 0)::BIGINT AS tick FROM c)
SELECT user_id, tick, count(*) AS n, round(avg(value), 9) AS mean_value FROM t WHERE tick < (calls - 1) // 10 GROUP BY user_id, tick
""")
def stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.to_table(S.count_ticks(S.event_stream(spark, sf_dir, 1 << 30)), "append")
    return found.select("user_id", "tick", "n", F.round("mean_value", 9).alias("mean_value"))


@query("SELECT source, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT CASE WHEN event_type = 'click' THEN 'clicks' ELSE 'others' END AS source, event_id FROM events) GROUP BY source")
def stream_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.event_stream(spark, sf_dir)
    both = S.merged({"clicks": events.where("event_type = 'click'"), "others": events.where("event_type <> 'click'")})
    return S.to_table(both.groupBy("source").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")), "complete")


@query("SELECT s.s_name, count(*) AS n FROM events e JOIN supplier s ON s.s_suppkey = e.user_id GROUP BY s.s_name")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name")
    joined = S.event_stream(spark, sf_dir).join(suppliers, F.col("user_id") == F.col("s_suppkey"))
    return S.to_table(joined.groupBy("s_name").agg(F.count("*").alias("n")), "complete")


@query("""
SELECT a.user_id, a.event_type, a.event_id AS earlier, b.event_id AS later FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND b.ts >= a.ts + INTERVAL 1 MINUTE AND b.ts <= a.ts + INTERVAL 12 HOURS
""")
def stream_lagged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events of one type that follow each other within half a day."""
    return S.to_table(S.lagged_pairs(S.event_stream(spark, sf_dir), ["user_id", "event_type"], "1 MINUTE", "12 HOURS"), "append")


@query("SELECT floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events GROUP BY 1")
def stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running histogram over the row groups of a table, a frame each."""
    frames.register(spark)
    rows = spark.readStream.format("frames").schema("event_id long, value double").load(f"{sf_dir}/events.parquet")
    return S.to_table(S.running_histogram(rows, F.floor(F.col("value") / 10)), "complete")


@query("""
WITH c AS (SELECT user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS calls, max(ts) OVER (PARTITION BY user_id) AS last, max(ts) OVER () AS now FROM events),
t AS (SELECT *, greatest(ceil(i / 10.0) - 1, 0)::BIGINT AS tick FROM c)
SELECT user_id, tick, count(*) AS n, round(avg(value), 9) AS mean_value, tick >= (any_value(calls) - 1) // 10 AS flushed FROM t
WHERE tick < (calls - 1) // 10 OR last + INTERVAL 6 HOURS < now - INTERVAL 1 HOUR GROUP BY user_id, tick
""")
def stream_flushed_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of each user, the open one too where the user has been silent for six hours."""
    found = S.to_table(ticks.flushed_ticks(S.event_stream(spark, sf_dir), 6 * 3600), "append", **dict([ticks.PROVIDER]))
    return found.select("user_id", "tick", "n", F.round("mean_value", 9).alias("mean_value"), "flushed")
