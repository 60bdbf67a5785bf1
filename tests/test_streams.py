"""Streams that start again, and joins of streams, against their batch forms."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quern.streaming import events as S
from quern.streaming import frames, ticks


def test_frames_go_on_after_a_restart(spark, tmp_path):
    """Five frames, then three more and a new file: no frame twice, none left out."""
    frames.register(spark)
    folder, out = tmp_path / "frames", tmp_path / "out"
    folder.mkdir()

    def put(name, first, groups):
        with pq.ParquetWriter(folder / name, pa.schema([("k", pa.int64()), ("other", pa.string())])) as file:
            for g in range(groups):
                file.write_table(pa.table({"k": [first + 10 * g + i for i in range(10)], "other": ["x"] * 10}), row_group_size=10)

    def run():
        batches = []
        stream = spark.readStream.format("frames").schema("k long, missing double").load(str(folder))
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda rows, n: (batches.append(n), rows.write.parquet(f"{out}/{n}"))[0]).start()
        query.awaitTermination()
        return batches

    put("a.parquet", 0, 5)
    assert len(run()) == 1 and run() == []
    put("b.parquet", 50, 3)
    put("c.parquet", 80, 1)
    assert len(run()) == 1
    rows = spark.read.parquet(f"{out}/*")
    assert sorted(r.k for r in rows.collect()) == list(range(90)) and rows.where("missing is not null").count() == 0


def test_pairs_over_many_batches_equal_one_batch(spark, sf_dir, tmp_path):
    """Events in files by time, one a batch: pairs whose events lie in different batches are found, and old state goes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = events.withColumn("part", F.floor(F.unix_seconds("ts") / 86400 / 4))
    for i, p in enumerate(sorted(r.part for r in days.select("part").distinct().collect())):
        days.where(F.col("part") == p).drop("part").coalesce(1).write.parquet(f"{tmp_path}/in/{i:03}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = S.to_table(S.lagged_pairs(source, ["user_id"], "0 SECONDS", "20 HOURS", "4 days"), "append")
    want = S.lagged_pairs(events, ["user_id"], "0 SECONDS", "20 HOURS")
    key = lambda df: sorted(map(tuple, df.select("earlier", "later").collect()))
    assert key(found) == key(want) and len(key(want)) > 100


def test_open_ticks_are_flushed_on_time(spark, tmp_path):
    """Two batches: a silent user's open tick comes with the second one's watermark; the others' stay in state."""
    schema = "event_id long, ts timestamp, user_id long, value double"
    at = lambda user, first, n, hour: [(first + i, f"2024-01-01 {hour:02}:00:{i:02}", user, float(i)) for i in range(n)]
    parts = [at(1, 0, 13, 1) + at(2, 100, 25, 1), at(2, 200, 3, 9)]

    def run(rows, n):
        spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        found = S.to_table(ticks.flushed_ticks(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), 3600), "append", f"{tmp_path}/run", **dict([ticks.PROVIDER]))
        return sorted(map(tuple, found.collect()))

    (tmp_path / "in").mkdir()
    first = [(1, 0, 11, 5.0, False), (2, 0, 11, 5.0, False), (2, 1, 10, 15.5, False)]
    assert run(parts[0], 0) == first
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/run/checkpoint")
    assert Counter(r.key.user_id for r in state.collect()) == {1: 2, 2: 4}
    # at nine the clock stands at eight: user 2's own old timer is replaced by its new events
    assert run(parts[1], 1) == sorted([*first, (1, 1, 2, 11.5, True)])


def test_ticks_do_not_depend_on_arrow_batches_or_files(spark, tmp_path):
    """Two users' events in files against the order of their numbers, in batches of seven rows: ticks are those of the order."""
    for name, ids in (("b", range(0, 60)), ("a", range(60, 120)), ("c", range(120, 150))):
        rows = [(i, "2024-01-01 00:00:00", i % 2, "view", float(i * i), "") for i in ids]
        frame = spark.createDataFrame(rows[::-1], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.user_id, r.tick): (r.n, r.mean_value) for r in S.to_table(S.count_ticks(S.event_stream(spark, str(tmp_path))), "append").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for user in (0, 1):
        values = [float(i * i) for i in range(user, 150, 2)]
        cuts = [0, *range(11, 75, 10)]
        want |= {(user, t): (hi - lo, sum(values[lo:hi]) / (hi - lo)) for t, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert got == want
