import itertools
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import similarity


def all_pairs(cells, threshold):
    rows = defaultdict(lambda: defaultdict(float))
    for i, k, v in cells:
        if i is not None and k is not None and v is not None:
            rows[i][k] += v
    length = {i: sum(v * v for v in r.values()) ** 0.5 for i, r in rows.items()}
    found = {}
    for i, j in itertools.combinations(sorted(x for x in rows if length[x]), 2):
        c = sum(v * rows[j].get(k, 0.0) for k, v in rows[i].items()) / length[i] / length[j]
        if c >= threshold:
            found[i, j] = c
    return found


@pytest.mark.parametrize(("threshold", "suffix"), [(0.3, None), (0.6, 0.2), (0.9, None), (1.0, None)])
def test_equals_all_pairs(spark, threshold, suffix):
    """Signed values, a column that all rows have, repeated and cancelling cells, equal rows, a row of zeros, nulls."""
    rng = random.Random(4)
    cells = [(i, k, rng.choice([-1, 1, 1, 1]) * rng.uniform(0.1, 3)) for i in range(60) for k in rng.sample(range(40), rng.randint(1, 6))]
    cells += [(i, 99, 0.3) for i in range(60)] + [(70, k, 1.0 + k) for k in range(30)] + [(71, k, 1.0 + k) for k in range(30)] + [(72, 5, 2.0), (72, 5, -2.0), (73, 7, 0.0), (74, 8, 5.0), (75, 8, 1.0)]
    cells += [(None, 1, 1.0), (80, None, 1.0), (81, 1, None)]
    got = {(r.i, r.j): r.cosine for r in similarity.similarity_join(spark.createDataFrame(cells, "i int, k int, v double"), threshold - 1e-12, suffix).collect()}
    want = all_pairs(cells, threshold - 1e-12)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_few_pairs_are_verified(spark, sf_dir):
    """Under a tenth of all pairs of parts are candidates, and no pair is lost."""
    cells = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").groupBy(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").alias("v"))
    unit = similarity.unit_rows(cells).checkpoint()
    n, met = cells.select("i").distinct().count(), similarity.candidates(unit, 0.52, 0.25).count()
    assert met < n * (n - 1) / 2 / 10


def test_awkward_tables(spark):
    none = spark.createDataFrame([], "i int, k int, v double")
    assert similarity.similarity_join(none, 0.5).count() == 0
    for bad in (0.0, 1.1):
        with pytest.raises(ValueError, match="threshold"):
            similarity.similarity_join(none, bad)


@pytest.mark.parametrize(("rows", "cells", "pairs"), [(5, 512, 40), (1024, 4, 1 << 22), (6, 5, 40)])
def test_long_rows_and_hot_columns_lose_no_pair(spark, monkeypatch, rows, cells, pairs):
    """Columns in blocks, rows that don't travel whole, many groups a task: all give the pairs of the plain rule."""
    rng = random.Random(6)
    table = [(f"r{i:02}", k, rng.choice([-1, 1, 1, 1]) * rng.uniform(0.1, 3)) for i in range(50) for k in rng.sample(range(12), rng.randint(1, 8))]
    table += [(f"s{i:02}", 99, 1.0) for i in range(40)]
    monkeypatch.setattr(similarity, "COLUMN_ROWS", rows)
    monkeypatch.setattr(similarity, "ROW_CELLS", cells)
    monkeypatch.setattr(similarity, "PAIRS", pairs)
    found = similarity.similarity_join(spark.createDataFrame(table, "i string, k int, v double"), 0.6).collect()
    want = all_pairs(table, 0.6)
    assert len(found) == len(want) > 800 and all(r.cosine == pytest.approx(want[r.i, r.j]) for r in found)


def test_no_row_is_shuffled_for_a_product(spark, monkeypatch):
    """Columns that all rows have bring them together by a record each: rows that travel whole never come as products."""
    monkeypatch.setattr(similarity, "candidates", None)
    cells = spark.range(400).selectExpr("id % 399 + id div 399 * 399 as i", "explode(array(id % 399, 1000, 1001)) as k", "1.0D as v")
    assert [(r.i, r.j) for r in similarity.similarity_join(cells, 0.9).collect()] == [(0, 399)]


def shuffled(spark):
    """Bytes that the stages so far have written for exchanges."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_little_is_shuffled_for_long_prefixes(spark):
    """Prefixes of 20 of 30 cells: fewer than 60 bytes for each cell of the table, where whole rows at each place took 87."""
    cells = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("v"))
    before = shuffled(spark)
    assert similarity.similarity_join(cells, 0.523456).count() == 510
    assert 0 < shuffled(spark) - before < 60 * cells.count()


def test_a_heavy_row_comes_in_parts(spark, monkeypatch):
    """Rows of more than PART_CELLS cells are dealt to several tasks, and meet the others all the same."""
    monkeypatch.setattr(similarity, "PART_CELLS", 50)
    rng = random.Random(8)
    table = [(i, k, rng.choice([-1, 1, 1, 1]) * rng.uniform(0.1, 3)) for i in range(40) for k in rng.sample(range(30), 8)]
    table += [(i, k, 1.0 + k % 3) for i in (50, 51) for k in range(i, 250)]
    frame = spark.createDataFrame(table, "i int, k int, v double")
    parts = {(r.i, r.part) for r in similarity._rows(frame).collect()}
    assert {i for i, part in parts if part} >= {50, 51} and all(sum(x == i for x, _ in parts) > 2 for i in (50, 51))
    got, want = {(r.i, r.j): r.cosine for r in similarity.similarity_join(frame, 0.4).collect()}, all_pairs(table, 0.4)
    assert got.keys() == want.keys() and (50, 51) in got and all(got[p] == pytest.approx(want[p]) for p in want)


def test_sketches_bound_the_cosine(spark, monkeypatch):
    """Columns that share a code, buckets of columns and rows of many ranges only add candidates; a pair is never lost."""
    monkeypatch.setattr(similarity, "CODES", 4)
    monkeypatch.setattr(similarity, "COLUMN_BUCKETS", 2)
    monkeypatch.setattr(similarity, "SKETCH_BYTES", 64)
    monkeypatch.setattr(similarity, "PAIRS", 30)
    monkeypatch.setattr(similarity, "PRODUCTS", 10)
    rng = random.Random(9)
    table = [(i, f"k{k}", rng.choice([-1, 1, 1]) * rng.uniform(0.01, 5)) for i in range(70) for k in rng.sample(range(25), rng.randint(1, 20))]
    got = {(r.i, r.j): r.cosine for r in similarity.similarity_join(spark.createDataFrame(table, "i long, k string, v double"), 0.35).collect()}
    want = all_pairs(table, 0.35)
    assert got.keys() == want.keys() and len(want) > 100 and all(got[p] == pytest.approx(want[p]) for p in want)


def test_a_row_goes_to_a_range_of_columns_once():
    """Cells of one shelf are one record, with the sketch from its first on; without shelves there is a record for each cell of the prefix."""
    k = list(range(90, 110))
    batch = pa.RecordBatch.from_pydict({"i": [7], "codes": [[x * 0x9E3779B97F4A7 for x in k]], "k": [k], "v": [[20**-0.5] * 20]})
    counts = np.ones(similarity.COLUMN_BUCKETS, np.int64)
    (one,) = similarity._postings(counts, np.array([100]), 1, 0.5, 1000)(iter([batch]))
    assert one.num_rows == 2 and [len(x) for x in one.column("places").to_pylist()] == [20, 12] and [len(x) for x in one.column("sketch").to_pylist()] == [40, 20]
    (each,) = similarity._postings(counts, np.array([], np.int64), 0, 0.5, 1000)(iter([batch]))
    assert [len(x) for x in each.column("sketch").to_pylist()] == [2 * n for n in range(20, 4, -1)]


@pytest.mark.parametrize(("cells", "shelves", "rows"), [(1 << 20, 1024, 8192), (20, 1024, 6), (20, 3, 8192), (20, 3, 6)])
def test_ranges_of_columns_lose_no_pair(spark, monkeypatch, cells, shelves, rows):
    """Shelves of a few columns, shelves in parts, columns in blocks, negative columns, and more records than a task looks at."""
    for name, x in (("SHELF_CELLS", cells), ("SHELVES", shelves), ("COLUMN_ROWS", rows)):
        monkeypatch.setattr(similarity, name, x)
    rng = random.Random(11)
    table = [(i, 10**12 * (k % 3 - 1) + k, rng.choice([-1, 1, 1, 1]) * rng.uniform(0.1, 3)) for i in range(60) for k in rng.sample(range(30 if i % 2 else 8), 7)]
    got = {(r.i, r.j): r.cosine for r in similarity.similarity_join(spark.createDataFrame(table, "i long, k long, v double"), 0.5).collect()}
    want = all_pairs(table, 0.5)
    assert got.keys() == want.keys() and len(want) > 50 and all(got[p] == pytest.approx(want[p]) for p in want)
