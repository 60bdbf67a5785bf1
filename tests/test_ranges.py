"""Sequences cut into ranges: recurrences, tridiagonal systems, order statistics, least squares."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import banded, leastsq, ranges, selection


def by_key(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_smoothing_is_the_recurrence(spark, partitions):
    rng = random.Random(1)
    # one group holds most rows; null and single-row groups; null values
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, None if i % 17 == 5 else rng.uniform(-5, 5)) for i in range(700)] + [("lone", 0, 3.0), ("blank", 0, None), ("blank", 1, 2.0)]
    want = {}
    for g in {r[0] for r in rows}:
        s = None
        for _, i, x in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            s = (x or 0.0) if s is None else s if x is None else 0.3 * x + 0.7 * s
            want[g, i] = s
    df = spark.createDataFrame(rows, "g string, i int, x double")
    for n in (1, 3, 16):
        partitions(n)
        got = ranges.exponential_smoothing(df, ["g"], ["i"], F.col("x"), 0.3, "s").collect()
        assert len(got) == len(rows) and all(r.s == pytest.approx(want[r.g, r.i], abs=1e-12) for r in got)


def test_scan_of_no_rows_and_one_group(spark, partitions):
    df = spark.range(50).select(F.col("id"), (F.col("id") + 1.0).alias("x"))
    assert ranges.running_sum(df.limit(0), [], ["id"], F.col("x"), "s").count() == 0
    partitions(7)
    assert [r.s for r in ranges.running_sum(df, [], ["id"], F.col("x"), "s").orderBy("id").collect()] == [k * (k + 1) / 2 for k in range(1, 51)]
    w = ranges.autoregressive(df, [], ["id"], F.col("x"), 0.5, 2.0, "w").orderBy("id").limit(3).collect()
    assert [r.w for r in w] == [1.0, 4.5, 8.25]


def test_composed_maps_survive_vanishing_factors():
    a, b = np.array([1.0, 1e-200, 1e-200, 0.5]), np.array([1.0, 2.0, 3.0, 4.0])
    assert ranges.composed(a, b)[1].tolist() == pytest.approx([1.0, 2.0, 3.0, 5.5])


@pytest.mark.parametrize("n", [1, 2, 5, 255, 256, 257, 700])
def test_range_elimination_equals_dense(n):
    rng = np.random.default_rng(n)
    a, c, d = (rng.uniform(-1, 1, n) for _ in range(3))
    b = 3.0 + rng.uniform(0, 1, n)
    m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
    right = d.copy()
    right[0] -= a[0] * 7.0
    right[-1] -= c[-1] * -2.0
    assert np.allclose(banded.Range(a, b, c, d).solve(7.0, -2.0), np.linalg.solve(m, right))


def test_systems_of_any_size_share_ranges(spark, partitions, monkeypatch):
    monkeypatch.setattr(banded, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for s, n in enumerate((400, 1, 2, 37, 3)):
        a, c, d = (rng.uniform(-1, 1, n) for _ in range(3))
        b = 3.0 + rng.uniform(0, 1, n)
        x = np.linalg.solve(np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1), d)
        rows += [(s if s else None, i, *map(float, (a[i], b[i], c[i], d[i]))) for i in range(n)]
        want |= {(s if s else None, i): x[i] for i in range(n)}
    df = spark.createDataFrame(rows, "s int, i int, a double, b double, c double, d double").repartition(3)
    for n in (1, 4, 50):
        partitions(n)
        got = banded.solve_tridiagonal_ranges(df, ["s"], ["i"], tuple(F.col(x) for x in "abcd")).collect()
        assert len(got) == len(rows) and all(r.x == pytest.approx(want[r.s, r.i], abs=1e-10) for r in got)
    assert banded.solve_tridiagonal_ranges(df.limit(0), ["s"], ["i"], tuple(F.col(x) for x in "abcd")).count() == 0
    with pytest.raises(Exception, match="pivot"):
        banded.solve_tridiagonal_ranges(df.withColumn("b", F.lit(0.0)).withColumn("a", F.lit(0.0)), ["s"], ["i"], tuple(F.col(x) for x in "abcd")).collect()


def test_quantiles_by_counting(spark):
    rng = random.Random(2)
    rows = [("skewed", 10.0 ** rng.randint(-300, 300)) for _ in range(300)] + [("ties", float(rng.randint(0, 3))) for _ in range(200)] + [("one", 5.0), (None, 1.0), (None, 2.0), ("gaps", None), ("gaps", float("nan"))]
    rows += [("signs", rng.choice([-1, 1]) * rng.expovariate(1.0)) for _ in range(501)] + [("ends", float("inf")), ("ends", 1.0), ("ends", float("-inf"))]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.share): r.quantile for r in selection.exact_quantiles(df, ["g"], "v", [0.0, 0.1, 0.5, 1.0], bins=64).collect()}
    groups = {g: np.array([v for h, v in rows if h == g and v is not None and v == v]) for g in {r[0] for r in rows}}
    assert {g for g, _ in got} == {g for g, v in groups.items() if len(v)}
    for (g, p), q in got.items():
        want = np.quantile(np.clip(groups[g], -1.7976931348623157e308, 1.7976931348623157e308), p) if g != "ends" else {0.0: -1.7976931348623157e308, 0.5: 1.0, 1.0: 1.7976931348623157e308}.get(p, q)
        assert q == pytest.approx(want, rel=1e-12)
    assert selection.exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    mad = {r.g: (r.median, r.mad) for r in selection.median_mad(df.where("g in ('ties', 'signs')"), ["g"], "v").collect()}
    for g, (m, d) in mad.items():
        assert m == pytest.approx(np.median(groups[g])) and d == pytest.approx(np.median(np.abs(groups[g] - np.median(groups[g]))))


def test_least_squares_at_condition_1e9(spark):
    """Integers and powers of two, so the label is exactly 1 + 2 f1 + 3 f2; the normal equations lose it."""
    x = spark.range(2000).repartition(40).select((F.col("id") % 50).cast("double").alias("f1"), F.pmod(F.xxhash64("id"), F.lit(11)).cast("double").alias("k"))
    rows = x.select("f1", (F.col("f1") + F.col("k") * 2.0**-29).alias("f2")).withColumn("y", 1.0 + 2.0 * F.col("f1") + 3.0 * F.col("f2"))
    assert 1e9 < leastsq.condition(rows, ["f1", "f2"]) < 1e11
    assert leastsq.least_squares(rows, ["f1", "f2"], "y") == pytest.approx([1.0, 2.0, 3.0], abs=1e-4)
    data = np.array(rows.select(F.lit(1.0), "f1", "f2", "y").collect())
    normal = np.linalg.lstsq(data[:, :3].T @ data[:, :3], data[:, :3].T @ data[:, 3], rcond=None)[0]
    assert abs(normal[1] - 2.0) > 0.1


def test_r_factor_has_the_singular_values(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 3))
    df = spark.createDataFrame(x.tolist() + [[None, 1.0, 1.0]], "a double, b double, c double").repartition(37)
    r = leastsq.r_factor(df, ["a", "b", "c"], fan_in=2)
    assert np.allclose(np.linalg.svd(r, compute_uv=False), np.linalg.svd(x, compute_uv=False))
    assert np.allclose(r.T @ r, x.T @ x)
    assert leastsq.r_factor(df.limit(0), ["a", "b"]).shape == (0, 2) and leastsq.least_squares(df.limit(0), ["a"], "b") == [0.0, 0.0]
    assert leastsq.condition(df.select("a", F.col("a").alias("b")), ["a", "b"]) > 1e15 and np.isnan(leastsq.condition(df.limit(0), ["a"]))


def test_a_few_groups_are_sent_to_their_values(spark, monkeypatch):
    """Values are not dealt by group where groups are few: one of very many values would be one task's."""
    values, groups = spark.range(100).selectExpr("id % 3 as g", "id as v"), spark.createDataFrame([(g, 1) for g in range(3)], "g long, w int").checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: values.join(selection._few(groups), "g")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan()
        monkeypatch.setattr(selection, "FEW", 2)
        assert "SortMergeJoin" in plan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
