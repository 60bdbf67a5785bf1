import random
import re

import pytest

from quern.operators import kdtree


def leaves_by_sorting(rows, depth):
    """(key, x, y) rows dealt by sorting whole nodes."""
    nodes = {0: rows}
    for _ in range(depth):
        after = {}
        for i, held in nodes.items():
            wide = max((1, 2), key=lambda k: (max(r[k] for r in held) - min(r[k] for r in held), -k)) if held else 1
            held = sorted(held, key=lambda r: (r[wide], r[0]))
            after[2 * i], after[2 * i + 1] = held[: (len(held) + 1) // 2], held[(len(held) + 1) // 2 :]
        nodes = after
    return {r[0]: i for i, held in nodes.items() for r in held}


@pytest.mark.parametrize("kind", ["skewed", "ties", "few"])
def test_leaves_are_even_and_those_of_sorting(spark, kind):
    rng = random.Random(7)
    n = 5 if kind == "few" else 301
    value = (lambda: float(rng.randint(0, 2))) if kind == "ties" else lambda: rng.expovariate(1.0) ** 4
    rows = [(k, value(), value()) for k in rng.sample(range(10_000), n)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    tree = kdtree.build(df, "k", ["x", "y"], 3)
    got = {r.k: r.leaf for r in tree.place(df).collect()}
    assert got == leaves_by_sorting(rows, 3) and tree.leaves == 8
    sizes = [sum(v == i for v in got.values()) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_boxes_leave_leaves_unread(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    placed = kdtree.build(df, "k", ["x", "y"], 4).place(df)
    kdtree.write_leaves(placed, f"{tmp_path}/leaves")
    bounds = kdtree.boxes(spark.read.parquet(f"{tmp_path}/leaves"), ["x", "y"])
    found = kdtree.read_box(spark, f"{tmp_path}/leaves", bounds, ["x", "y"], (-0.2, -0.2), (0.1, 0.3))
    assert sorted(r.k for r in found.collect()) == [k for k, x, y in rows if -0.2 <= x <= 0.1 and -0.2 <= y <= 0.3]
    assert 0 < len({r.leaf for r in found.select("leaf").distinct().collect()}) < 16
    assert re.search(r"PartitionFilters: \[[^\]]*leaf#", found._jdf.queryExecution().executedPlan().toString())
    assert kdtree.read_box(spark, f"{tmp_path}/leaves", bounds, ["x", "y"], (90, 90), (91, 91)).count() == 0


def test_points_without_coordinates_and_empty_tables(spark):
    rows = [(1, 0.0, 1.0), (2, None, 1.0), (3, float("nan"), 1.0), (4, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    tree = kdtree.build(df, "k", ["x", "y"], 1)
    assert {r.k: r.leaf for r in tree.place(df.dropna().where("not isnan(x)")).collect()} == {1: 0, 4: 1}
    assert kdtree.build(df.limit(0), "k", ["x", "y"], 2).place(df.limit(0)).count() == 0
