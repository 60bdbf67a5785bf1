import hashlib
import zlib
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm._common import in_order
from quern.llm.sharding import OP5_SQL, assign_shards, op5_feistel_shards, permuted, shards_sql, write_shards

from .helpers import awkward, awkward_rows, empty, rows_of


def test_permutation_of_every_small_size(spark):
    sizes = spark.range(0, 41).select(F.col("id").alias("total"))
    rows = sizes.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0))))).where("row < total")
    got = {}
    for r in permuted(rows, "row", "total", "at", 7).collect():
        got.setdefault(r.total, []).append(r.at)
    assert all(sorted(at) == list(range(n)) for n, at in got.items()) and len(got) == 40
    assert got[40] != list(range(40))


def test_awkward_rows(spark):
    rows = awkward_rows()
    got = assign_shards(awkward(spark), 7).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None)
    counts = Counter(r.shard for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    assert assign_shards(empty(spark), 7).count() == 0


def test_query_law_and_reproducibility(spark, sf_dir):
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    first = rows_of(op5_feistel_shards(spark, sf_dir), *columns)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7).orderBy(F.rand(3))
    assert rows_of(assign_shards(docs, 40), *columns) == first
    assert rows_of(assign_shards(docs, 40, seed=1), *columns) != first
    counts = Counter(r[4] for r in first)
    assert set(counts) <= set(range(40)) and max(counts.values()) - min(counts.values()) <= 1


def brute_permuted(x, total, seed=0):
    """The law in plain integers: six rounds over Z_a x Z_b, walked until it falls into range."""
    from math import isqrt

    a = max(1, isqrt(total - 1) + 1)
    b = max(1, -(-total // a))
    digest = lambda *v: int(hashlib.md5(":".join(map(str, v)).encode()).hexdigest()[:15], 16)

    while True:
        left, right = divmod(x, b)
        for i in range(6):
            if i % 2 == 0:
                left = (left + digest(seed, i, right) % a) % a
            else:
                right = (right + digest(seed, i, left) % b) % b
        x = left * b + right
        if x < total:
            return x


def test_permutation_equals_plain_integers(spark):
    for total in (1, 2, 37, 1000):
        rows = spark.range(total).select("id", F.lit(total).cast("long").alias("total"))
        got = {r.id: r["at"] for r in permuted(rows, "id", "total", "at", 3).collect()}
        assert got == {x: brute_permuted(x, total, 3) for x in range(total)}


def test_equal_rows_are_spread(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = assign_shards(docs, 7).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted((i % 7, i // 7) for i in range(3000))
    assert in_order(docs, ["doc_id"]).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500


def test_rows_equal_sql(spark, sf_dir):
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert rows_of(op5_feistel_shards(spark, sf_dir), *columns) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP5_SQL})").fetchall(), key=repr)
    con = duckdb.connect()
    con.register("documents", awkward(spark, clash=False).toArrow())
    assert rows_of(assign_shards(awkward(spark), 7, 5), *columns) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({shards_sql(7, 5)})").fetchall(), key=repr)


def test_written_shards_hold_the_texts(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_shards(docs, f"{tmp_path}/shards", 5)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.select("shard").distinct().count() == 5
    assert rows_of(back, "doc_id", "text") == rows_of(docs, "doc_id", "text")


def test_stash_is_written_and_cleared(spark):
    from quern.llm._common import clear_stash, stash

    table = stash(spark.range(5), "numbers")
    assert table.count() == 5 and all(f"/quern/{spark.sparkContext.applicationId}/numbers-" in f for f in table.inputFiles())
    clear_stash(spark)
    assert stash(spark.range(3), "numbers").count() == 3


def test_runs_delete_their_own_tables_alone(spark):
    """Another query's table stays while a run settles, in this thread and in others; a run that fails leaves none."""
    from quern.llm import _common

    other = _common.stash(spark.range(5), "other")
    held = []

    def make():
        held.append(_common.stash(spark.range(3), "own"))
        with ThreadPoolExecutor(1) as pool:
            held.append(pool.submit(_common.settle, lambda: _common.stash(spark.range(4), "theirs"), "their-result").result())
        return held[0].withColumn("x", F.lit(1))

    done = _common.settle(make, "result")
    assert done.count() == 3 and other.count() == 5 and held[1].count() == 4
    with pytest.raises(Exception, match="not_there|PATH_NOT_FOUND|FILE_NOT_EXIST|not exist"):
        held[0].count()

    def fail():
        held.append(_common.stash(spark.range(6), "failing"))
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        _common.settle(fail, "never")
    with pytest.raises(Exception, match="FILE_NOT_EXIST|not exist"):
        held[2].count()
