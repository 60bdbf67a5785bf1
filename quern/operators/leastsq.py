"""Least squares and condition numbers without squaring them: QR factors merged in a tree (survey M09, A36)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import use_checkpoints

#: Factors that one task of the tree merges.
FAN_IN = 16


def _stacked(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows if r is None else np.vstack((r, rows)), mode="r")


def r_factor(df: DataFrame, columns: Sequence[str | Column], fan_in: int = FAN_IN) -> np.ndarray:
    """R of the QR factors of the matrix whose rows are df's columns; rows with a null in one of them are left out.

    A task folds its rows, batch by batch, into one R of d x d numbers. FAN_IN of these are merged by the QR of their stack,
    until one is left: log n exchanges of d x d numbers a task, one R on the driver. R has the matrix' singular values,
    where X^T X has their squares. Fewer rows than columns, or none: R has as many rows as there are.
    """
    use_checkpoints(df.sparkSession)
    held = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    d = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                r = _stacked(r, np.column_stack([c.to_numpy() for c in batch.columns]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])], names=["node", "r"])

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        r = None
        for one in table.sort_by("node").column("r").to_pylist():
            r = _stacked(r, np.array(one).reshape(-1, d))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    level = held.mapInArrow(fold, "node long, r array<double>").checkpoint()
    last = level.agg(F.max("node")).first()[0]
    while last:  # node 0 alone is the root
        level = level.groupBy(F.floor(F.col("node") / fan_in).alias("parent")).applyInArrow(merge, "node long, r array<double>")
        last //= fan_in
    found = level.collect()
    return np.array(found[0].r).reshape(-1, d) if found else np.empty((0, d))


def least_squares(df: DataFrame, features: Sequence[str | Column], label: str | Column) -> list[float]:
    """Intercept and weights of least squares; of several solutions the shortest. An empty table has none: zeros."""
    r = r_factor(df, [F.lit(1.0), *features, label])
    return np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0].tolist() if len(r) else [0.0] * (len(features) + 1)


def condition(df: DataFrame, columns: Sequence[str | Column]) -> float:
    """The ratio of the extreme singular values of the columns; infinite where they depend on each other, NaN without rows."""
    r = r_factor(df, columns)
    if not len(r):
        return float("nan")
    s = np.linalg.svd(r, compute_uv=False)
    return float(s[0] / s[-1]) if len(s) == len(columns) and s[-1] else float("inf")
