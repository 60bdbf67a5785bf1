import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import neighbours
from quern.llm.neighbours import best_of, fit, nearest, op11_projection_forest

SCHEMA = "vec_id long, embedding array<float>, label int"
QUERY = "id % 20 = 0"


def brute(rows, n=20, is_query=lambda i: i % 20 == 0):
    """query_id, rank, vec_id, score of every query, by all pairs of distinct rows."""
    rows = sorted({(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows})
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = []
    for k, (i, q) in enumerate(rows):
        if is_query(i):
            score = sum(x[:, d] * q[d] for d in range(x.shape[1]))
            order = [j for j in np.lexsort((ids, -score)) if j != k][:n]
            out += [(i, r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return sorted(out)


def vectors(n, dim, seed=0, spread=0.0):
    rng = np.random.default_rng(seed)
    return [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, dim)) * np.exp(spread * rng.standard_normal((n, 1))))]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def recall(found, true):
    return len({(q, v) for q, _, v, _ in found} & {(q, v) for q, _, v, _ in true}) / len(true)


def test_awkward_rows(spark):
    good = vectors(60, 5)
    good += [(100 + i, good[7][1]) for i in range(30)] + [(20, good[20][1]), (20, good[20][1]), (40, good[3][1]), (120, [0.0, 0.0, 0.0, 0.0, 1.0]), (140, [-0.0, 0.0, 0.0, 0.0, 1.0])]
    bad = [(200, None), (None, good[0][1]), (220, [0.0] * 5), (240, [1.0, None, 1.0, 1.0, 1.0]), (260, [math.nan] * 5), (280, [math.inf, 0.0, 0.0, 0.0, 0.0]), (300, [1.0] * 4), (320, [])]
    df = frame(spark, good + bad).select("*", *[F.lit("x").alias(c) for c in ("id", "v", "h", "place", "query_id", "rank", "score", "tree")])
    got, want = rows_of(nearest(df, QUERY)), brute(good)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == [r[3] for r in want]
    assert nearest(frame(spark, []), QUERY).count() == 0
    assert nearest(frame(spark, bad[:1]), QUERY).count() == 0
    assert rows_of(nearest(frame(spark, good[:1]), QUERY)) == []
    assert rows_of(nearest(frame(spark, good[:9]), QUERY)) == brute(good[:9])


@pytest.mark.parametrize(("dim", "spread"), [(8, 0.0), (24, 0.0), (12, 1.0)])
def test_recall_and_exact_scores(spark, dim, spread):
    """Several levels of splits, and lengths that differ by e; a third of the rows are one vector."""
    rows = vectors(6000, dim, 1, spread)
    rows = [(i, rows[5][1] if i % 3 == 0 else v) for i, v in rows]
    got, want = rows_of(nearest(frame(spark, rows), QUERY)), brute(rows)
    assert len(got) == len(want) == 300 * 20
    assert recall(got, want) >= 0.9
    exact = {(q, v): s for q, _, v, s in brute([r for r in rows if r[0] % 20 == 0 or r[0] in {x[2] for x in got}], 6000) if q <= 200}
    assert all(s == exact[q, v] for q, _, v, s in got if q <= 200)
    by_query = {}
    for q, r, v, s in got:
        by_query.setdefault(q, []).append((-s, v, r))
    assert all([x[2] for x in sorted(b)] == list(range(1, 21)) for b in by_query.values())


def test_query_on_given_table(spark):
    """The whole table of sf0.1: 2,000 vectors without structure."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = rows_of(op11_projection_forest(spark, "/root/testdata/sf0.1"))
    assert len(got) == len(want) and recall(got, want) >= 0.9


def test_searches_that_meet_too_few_rows_go_on(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 8)
    monkeypatch.setattr(neighbours, "calibrate", lambda *_: 1)
    rows = vectors(400, 6, 3)
    got = rows_of(nearest(frame(spark, rows), QUERY))
    assert len(got) == 20 * 20 and len({r[:2] for r in got}) == 400


def test_queue_visits_every_leaf_once_nearest_first():
    x = np.array([v for _, v in vectors(3000, 6, 2)])
    forest = fit(x, float(np.abs(x).max()), float(np.linalg.norm(x / np.abs(x).max(), axis=1).max()), 5)
    walk = list(forest.visits(x[0]))
    assert sorted(walk) == [(t, leaf) for t in range(4) for leaf in range(32)]
    leaves = forest.leaves(x)
    assert np.bincount(leaves[:, 0], minlength=32).min() > 60  # medians halve every node
    lifted = forest.lifted(x)
    assert np.allclose(np.linalg.norm(lifted, axis=1), forest.longest)
    # the box of a query's own leaf is the nearest of its tree only if it isn't lifted; its position is early all the same
    assert all(min(walk.index((t, leaf)) for t, leaf in enumerate(row)) < 40 for row in leaves[:1])


def test_best_of_ties_go_to_the_smaller_id():
    v = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    place, query, score = best_of(np.array([[1.0, 0.0]]), v, np.array([9, 4, 1, 6]), 2)
    assert place.tolist() == [1, 3] and query.tolist() == [0, 0] and score.tolist() == [1.0, 1.0]


def test_merged_keeps_the_best_of_each_query_once():
    rows = np.array([(1, 0, -2.0, 5, 0), (1, 0, -3.0, 6, 0), (1, 0, -3.0, 6, 0), (2, 0, -1.0, 5, 0), (1, 0, -3.0, 4, 0), (1, 7, 0.0, 9, 0)], neighbours._FOUND)
    assert neighbours.merged(rows, 2).tolist() == [(1, 0, -3.0, 4, 0), (1, 0, -3.0, 6, 0), (1, 7, 0.0, 9, 0), (2, 0, -1.0, 5, 0)]
    assert len(neighbours.merged(rows[:0], 2)) == 0


def test_results_do_not_depend_on_what_a_task_holds(spark, monkeypatch):
    rows = vectors(3000, 8, 4)
    one = rows_of(nearest(frame(spark, rows), QUERY))
    monkeypatch.setattr(neighbours, "HELD", 50)
    assert rows_of(nearest(frame(spark, rows), QUERY)) == one
