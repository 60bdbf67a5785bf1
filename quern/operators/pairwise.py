"""Pairwise distances, in blocks: every pair is met once, in the task of its pair of blocks (survey J01-J06, A37)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import array_distance, dot, doubles, norm

#: Vectors of a block, at least and at most, and the blocks of tables in between; a task holds two blocks and the distances of TILE by TILE vectors.
BLOCK, MOST, BLOCKS, TILE = 512, 1 << 16, 16, 512


def _blocks(n_rows: int, block: int) -> int:
    return max(1, -(-n_rows // block))


def block_size(n_rows: int) -> int:
    """BLOCKS blocks up to BLOCKS * MOST vectors, so that what is shuffled grows with the table; beyond that a task's memory is the limit."""
    return min(MOST, max(BLOCK, -(-n_rows // BLOCKS)))


def block_pairs(vectors: DataFrame, key: str, block: int | None = None) -> DataFrame:
    """Deal (key, v, ...) rows to pairs of blocks (bi <= bj): row block b goes to every pair with b in it.

    A group holds two blocks of about `block` rows, block_size of them by default; the number of pairs of rows grows with the
    square of the table, as the result does.
    """
    rows = vectors.count()
    n = _blocks(rows, block or block_size(rows))
    held = vectors.withColumn("b", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    held = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return held.withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o")


#: Squared distances below this are summed up again from the differences, which the norm trick would cancel.
NEAR = 1e-6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two blocks, by |a|^2 + |b|^2 - 2 a.b, whose products BLAS does; near pairs are computed exactly."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    i, j = np.nonzero(d < NEAR)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        d[x, y] = ((a[x] - b[y]) ** 2).sum(1)
    return np.sqrt(d)


def _pair_sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Count, sum, sum of squares, least and greatest distance by label pair, of the pairs of two blocks."""
    left, right = (rows[rows["b"] == b] for b in key)
    if not len(left) or not len(right):
        return pd.DataFrame({c: [] for c in ("label_a", "label_b", "n", "s", "q", "low", "high")})
    a, b = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (left, right))
    ids, others = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    labels, code = np.unique(np.concatenate((left["label"], right["label"])), return_inverse=True)
    k, codes, other_codes = len(labels), code[: len(left)], code[len(left) :]
    low, high = np.full(k * k, np.inf), np.full(k * k, -np.inf)
    n, s, q = np.zeros(k * k, np.int64), np.zeros(k * k), np.zeros(k * k)
    for i, j in ((i, j) for i in range(0, len(a), TILE) for j in range(0, len(b), TILE)):
        one, other = slice(i, i + TILE), slice(j, j + TILE)
        d = _distances(a[one], b[other])
        la, lb = codes[one][:, None], other_codes[other][None, :]
        first = ids[one][:, None] < others[other][None, :]
        pair = np.where(first, la * k + lb, lb * k + la)
        pair, d = (x[first] for x in (pair, d)) if key[0] == key[1] else (pair.ravel(), d.ravel())
        np.minimum.at(low, pair, d)
        np.maximum.at(high, pair, d)
        n += np.bincount(pair, minlength=k * k)
        s += np.bincount(pair, d, k * k)
        q += np.bincount(pair, d * d, k * k)
    at = np.flatnonzero(n)
    return pd.DataFrame({"label_a": labels[at // k], "label_b": labels[at % k], "n": n[at], "s": s[at], "q": q[at], "low": low[at], "high": high[at]})


def distance_stats(embeddings: DataFrame) -> DataFrame:
    """Unit vectors, then count, mean, deviation, least and greatest distance of all pairs by label pair.

    Each pair of blocks gives a row for each label pair, so what is shuffled after the comparison is small.
    """
    v = doubles(F.col("embedding"))
    n = norm(v)
    unit = embeddings.select("vec_id", "label", F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v).alias("v"))
    sums = block_pairs(unit, "vec_id").groupBy("bi", "bj").applyInPandas(_pair_sums, "label_a int, label_b int, n long, s double, q double, low double, high double")
    total = sums.groupBy("label_a", "label_b").agg(F.sum("n").alias("pairs"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("low").alias("low"), F.max("high").alias("high"))
    mean = F.col("s") / F.col("pairs")
    return total.select(
        "label_a",
        "label_b",
        "pairs",
        F.round(mean, 6).alias("mean_distance"),
        F.round(F.sqrt(F.greatest(F.col("q") / F.col("pairs") - mean * mean, F.lit(0.0))), 6).alias("std_distance"),
        F.round("low", 6).alias("min_distance"),
        F.round("high", 6).alias("max_distance"),
    )


def against_few(vectors: DataFrame, few: DataFrame, form: str = "broadcast") -> DataFrame:
    """Distance of each (id, v) to each (other_id, w) of a table of stated, small size: a broadcast nested loop in the JVM.

    form: "broadcast" sums squared differences, "norms" uses |x|^2 + |y|^2 - 2 x.y with abs, "einsum" contracts the index that
    the difference and itself share, as rows and a grouped sum, and "mapped" maps a function of one pair over both tables.
    """
    if form == "einsum":
        cells = lambda df, key, column, v: df.select(key, F.posexplode(column).alias("k", v))
        met = cells(vectors, "id", "v", "x").join(F.broadcast(cells(few, "other_id", "w", "y")), "k")
        return met.groupBy("id", "other_id").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("distance"))
    if form == "mapped":
        one = lambda v, w: F.sqrt(F.aggregate(F.zip_with(v, w, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
        table = few.agg(F.collect_list(F.struct("other_id", "w")).alias("few"))
        held = vectors.crossJoin(F.broadcast(table))  # one row: the table of stated size
        return held.select("id", F.explode(F.transform("few", lambda o: F.struct(o["other_id"].alias("other_id"), one(F.col("v"), o["w"]).alias("distance")))).alias("p")).select("id", "p.*")
    if form == "norms":
        few = few.withColumn("wn", dot(F.col("w"), F.col("w")))
        vectors = vectors.withColumn("vn", dot(F.col("v"), F.col("v")))
        distance: Column = F.sqrt(F.abs(F.col("vn") + F.col("wn") - 2.0 * dot(F.col("v"), F.col("w"))))
    else:
        distance = array_distance(F.col("v"), F.col("w"))
    return vectors.crossJoin(F.broadcast(few)).select("id", "other_id", distance.alias("distance"))


def nearest(vectors: DataFrame, few: DataFrame) -> DataFrame:
    """For each id the nearest other_id, the first one on ties."""
    return against_few(vectors, few).groupBy("id").agg(F.min_by("other_id", F.struct("distance", "other_id")).alias("nearest"), F.min("distance").alias("distance"))
