"""Structured Streaming twins of the incremental operators (survey T01-T07); each can be held against its batch form."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.checkpoints import shared_folder

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def folder(spark: SparkSession) -> str:
    """A new folder for results and checkpoints."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 100) -> DataFrame:
    """The events table, a file or a folder of files, as a stream, with a zoned timestamp, since watermarks need one."""
    source = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    # a pattern, since a stream takes no single file by its name
    return source.parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def to_table(stream: DataFrame, mode: str, at: str | None = None, **conf: str) -> DataFrame:
    """Run what is available now to its end, and return the sink's rows: all of them in append mode, the last result in complete mode.

    at: the folder of rows and checkpoint, a new one by default. conf: settings that the query starts with.
    """
    spark = stream.sparkSession
    at = at or folder(spark)

    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch if mode == 'append' else 0}")

    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")


def tumbling(events: DataFrame, length: str, late: str = "1 day") -> DataFrame:
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, length: str, step: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame, keys: list[str], late: str = "40 days") -> DataFrame:
    """The first row of each key within the watermark; state is dropped as it passes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def running_histogram(events: DataFrame, bin_of: Column) -> DataFrame:
    return events.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))


def merged(streams: dict[str, DataFrame]) -> DataFrame:
    """Many sources into one stream, each row with its source."""
    out = None
    for name, stream in streams.items():
        tagged = stream.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def lagged_pairs(events: DataFrame, on: list[str], low: str, high: str, late: str = "1 day") -> DataFrame:
    """(on..., earlier, later) of event ids: pairs that agree in on, the later one from low to high after the earlier one.

    A join of the stream with itself. Both sides have a watermark and the condition bounds their distance in time, so a side
    keeps a row only as long as a partner can still come; in batch the same rows come out of the same plan.
    """
    one = events.withWatermark("ts", late).select(*[F.col(c).alias(f"a_{c}") for c in on], F.col("ts").alias("a_ts"), F.col("event_id").alias("earlier"))
    other = events.withWatermark("ts", late).select(*[F.col(c).alias(f"b_{c}") for c in on], F.col("ts").alias("b_ts"), F.col("event_id").alias("later"))
    same = F.col("earlier") != F.col("later")
    for c in on:
        same = same & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    when = F.expr(f"b_ts >= a_ts + INTERVAL {low} AND b_ts <= a_ts + INTERVAL {high}")
    return one.join(other, same & when).select(*[F.col(f"a_{c}").alias(c) for c in on], "earlier", "later")


def _tick(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: calls so far, and count and sum of the open tick. The first tick closes with the eleventh call, later ones with every tenth."""
    calls, n, total, tick = state.get if state.exists else (0, 0, 0.0, 0)
    out = []
    # the parts are what Arrow's batches hold, in any order: a user's numbers and values of a trigger are sorted as one
    for value in pd.concat([part[["event_id", "value"]] for part in rows]).sort_values("event_id")["value"]:
        n, total = n + 1, total + value
        if calls % 10 == 0 and calls > 0:
            out.append((key[0], tick, n, total / n))
            n, total, tick = 0, 0.0, tick + 1
        calls += 1
    state.update((calls, n, total, tick))
    yield pd.DataFrame(out, columns=["user_id", "tick", "n", "mean_value"])


def count_ticks(events: DataFrame) -> DataFrame:
    """(user_id, tick, n, mean_value) by count-based tumbling ticks of each user; an open tick is never flushed.

    Calls are in the order of event_id within a trigger, and triggers in that of their arrival. A task holds two numbers for
    each event that one user has in one trigger.
    """
    return events.select("user_id", "event_id", "value").groupBy("user_id").applyInPandasWithState(_tick, "user_id long, tick long, n long, mean_value double", "calls long, n long, total double, tick long", "append", GroupStateTimeout.NoTimeout)
