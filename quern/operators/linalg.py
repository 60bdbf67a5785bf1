"""Matrices as relations (i, k, v), and dense blocks where BLAS pays (survey J18-J22, J24, A36, M11, W17)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import use_checkpoints


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of A x; A: (i, k, v), x: (k, v)."""
    return a.join(x.withColumnRenamed("v", "xv"), "k").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of A B for sparse relations; A: (i, k, v), B: (k, j, v).

    Both sides are plain exchanges by k, so AQE splits a k that holds very many cells; where most cells are there, block_matmul
    sends less. Products are added up before they are dealt by (i, j).
    """
    return a.join(b.withColumnRenamed("v", "bv"), "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("bv")).alias("v"))


def check_shapes(columns_of_a: int, rows_of_b: int) -> None:
    if columns_of_a != rows_of_b:
        raise ValueError(f"A has {columns_of_a} columns, B has {rows_of_b} rows")


def block_matmul(a: DataFrame, b: DataFrame, n: tuple[int, int, int], block: int = 256) -> DataFrame:
    """(i, j, v) of dense A (n0 x n1) times B (n1 x n2), by block products in BLAS.

    Block (I, K) of A goes to every J, block (K, J) of B to every I; a group holds the two factors of one
    block product, and the products are summed over K by a partial aggregation.
    """
    beyond = lambda c, size: F.when((F.col(c) < 0) | (F.col(c) >= size), F.raise_error(F.concat(F.lit(f"{c} outside 0..{size - 1}: "), F.col(c).cast("string"))).cast("boolean")).otherwise(True)
    a, b = a.where(beyond("i", n[0]) & beyond("k", n[1])), b.where(beyond("k", n[1]) & beyond("j", n[2]))
    nb = [-(-x // block) for x in n]
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    left = a.select(at("i").alias("I"), at("k").alias("K"), every(nb[2]).alias("J"), F.lit(0).alias("side"), (F.col("i") % block).cast("int").alias("r"), (F.col("k") % block).cast("int").alias("c"), F.col("v").cast("double").alias("v"))
    right = b.select(every(nb[0]).alias("I"), at("k").alias("K"), at("j").alias("J"), F.lit(1).alias("side"), (F.col("k") % block).cast("int").alias("r"), (F.col("j") % block).cast("int").alias("c"), F.col("v").cast("double").alias("v"))

    def product(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = np.zeros((2, block, block))
        sides[rows["side"].to_numpy(), rows["r"].to_numpy(), rows["c"].to_numpy()] = rows["v"].to_numpy()
        out = sides[0] @ sides[1]
        r, c = np.nonzero(out)
        return pd.DataFrame({"i": key[0] * block + r, "j": key[2] * block + c, "v": out[r, c]})

    parts = left.select("I", "J", "K", "side", "r", "c", "v").unionByName(right.select("I", "J", "K", "side", "r", "c", "v"))
    return parts.groupBy("I", "K", "J").applyInPandas(lambda key, rows: product(key, rows), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose_sum(a: DataFrame) -> DataFrame:
    """(i, j, v) of A + A transposed; A: (i, j, v)."""
    return a.unionByName(a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def gram(rows: DataFrame) -> DataFrame:
    """(f1, f2, v) of X^T X for sparse rows (id, f, v)."""
    return rows.select("id", F.col("f").alias("f1"), F.col("v").alias("v1")).join(rows.select("id", F.col("f").alias("f2"), F.col("v").alias("v2")), "id").groupBy("f1", "f2").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))


def gram_dense(vectors: DataFrame, column: str) -> np.ndarray:
    """X^T X of an array column of fixed width: a d x d matrix from each task, summed; d x d numbers come to the driver.

    An empty table has a matrix without rows."""

    def partial(batches):
        total = None
        for rows in batches:
            x = np.stack(rows[column].to_numpy()).astype(np.float64)
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    found = vectors.select(column).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(found["i"].max()) + 1 if len(found) else 0
    out = np.zeros((d, d))
    out[found["i"], found["j"]] = found["v"]
    return out


def condition_number(gram_matrix: np.ndarray, n: int) -> float:
    """Of the covariance X^T X / n: the ratio of its extreme eigenvalues; NaN without rows."""
    if not n:
        return float("nan")
    values = np.linalg.eigvalsh(gram_matrix / n)
    return float(values[-1] / values[0])


#: Particles of a block: a task holds two blocks and their force matrix.
BODIES = 2048


def gravity(particles: DataFrame, g: float = 1.0, softening: float = 0.01, block: int = BODIES) -> DataFrame:
    """(id, fx, fy): softened attraction by all other particles (id, x, y, m).

    Particles are dealt to blocks by a hash of their id, as many as keep them near `block` particles, and each pair of blocks is a
    group: its forces are one matrix, and what leaves it is a row for each particle. So tasks are of one size, and there are
    as many as the square of the number of blocks.
    """
    n = max(1, -(-particles.count() // block))
    held = particles.select("id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "m")]).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = held.withColumn("o", other).select(F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "id", "x", "y", "m")
    kind = particles.schema["id"].dataType.simpleString()

    def pull(on: pd.DataFrame, by: pd.DataFrame, same: bool) -> pd.DataFrame:
        fx, fy = np.empty(len(on)), np.empty(len(on))
        x, y, m = (by[c].to_numpy() for c in "xym")
        for at in range(0, len(on), 256):  # so many rows of the matrix at once
            part = on.iloc[at : at + 256]
            dx, dy = x[None, :] - part["x"].to_numpy()[:, None], y[None, :] - part["y"].to_numpy()[:, None]
            force = g * part["m"].to_numpy()[:, None] * m[None, :] / (dx * dx + dy * dy + softening * softening) ** 1.5
            if same:
                i = np.arange(len(part))
                force[i, at + i] = 0.0
            fx[at : at + 256], fy[at : at + 256] = (force * dx).sum(1), (force * dy).sum(1)
        return pd.DataFrame({"id": on["id"].to_numpy(), "fx": fx, "fy": fy})

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        a, b = (rows[rows["b"] == k] for k in key)
        return pull(a, a, True) if key[0] == key[1] else pd.concat([pull(a, b, False), pull(b, a, False)])

    parts = dealt.groupBy("bi", "bj").applyInPandas(meet, f"id {kind}, fx double, fy double")
    return parts.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def thomas(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A tridiagonal system: elimination forward, substitution back."""
    n = len(diagonal)
    c, d = np.zeros(n), np.zeros(n)
    c[0], d[0] = upper[0] / diagonal[0], right[0] / diagonal[0]
    for i in range(1, n):
        pivot = diagonal[i] - lower[i] * c[i - 1]
        c[i] = upper[i] / pivot
        d[i] = (right[i] - lower[i] * d[i - 1]) / pivot
    x = d.copy()
    for i in range(n - 2, -1, -1):
        x[i] -= c[i] * x[i + 1]
    return x


def _per_system(solve: Callable[[pd.DataFrame], np.ndarray]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return pd.DataFrame({"system": rows["system"], "i": rows["i"], "x": solve(rows)})

    return run


def solve_tridiagonal(systems: DataFrame) -> DataFrame:
    """(system, i, x) of independent systems (system, i, a, b, c, d), a task for each at a time."""
    solve = _per_system(lambda r: thomas(*(r[c].to_numpy(np.float64) for c in "abcd")))
    return systems.groupBy("system").applyInPandas(solve, "system long, i long, x double")


def solve_dense(systems: DataFrame) -> DataFrame:
    """(system, i, x) of independent dense systems (system, i, row array, d)."""
    solve = _per_system(lambda r: np.linalg.solve(np.stack(r["row"].to_numpy()), r["d"].to_numpy(np.float64)))
    return systems.groupBy("system").applyInPandas(solve, "system long, i long, x double")


def solve_large(a: DataFrame, b: DataFrame, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """(i, v) that solves A x = b for one symmetric, positive definite matrix (i, k, v) of any size, sparse or dense, and b (i, v).

    Conjugate gradients: a step is one product of A with a vector and two sums, so no task holds a row of A, let alone A. The vectors are
    checkpointed. Stops once the residual is `tolerance` of b's length, or after `most` steps with an error, or as soon as a step
    shows that A isn't positive definite.
    """
    use_checkpoints(a.sparkSession)
    square = lambda df, c: df.agg(F.sum(F.col(c) * F.col(c))).first()[0] or 0.0
    state = b.select("i", F.lit(0.0).alias("x"), F.col("v").cast("double").alias("r"), F.col("v").cast("double").alias("p")).checkpoint()
    goal = square(state, "r") * tolerance * tolerance
    size = goal / (tolerance * tolerance) if tolerance else 0.0
    for step in range(1, most + 1):
        if size <= goal:
            return state.select("i", F.col("x").alias("v"))
        pushed = matvec(a, state.select(F.col("i").alias("k"), F.col("p").alias("v"))).withColumnRenamed("v", "q")
        state = state.join(pushed, "i", "left").fillna(0.0, ["q"]).persist()
        bent = state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not bent > 0:
            raise ValueError(f"the matrix isn't positive definite: p A p is {bent} in step {step}")
        along = size / bent
        moved = state.select("i", (F.col("x") + along * F.col("p")).alias("x"), (F.col("r") - along * F.col("q")).alias("r"), "p")
        after = square(moved, "r")
        turned = moved.withColumn("p", F.col("r") + (after / size) * F.col("p"))
        before, state, size = state, turned.checkpoint(), after
        before.unpersist()
    raise RuntimeError(f"no solution to {tolerance} after {most} steps")
