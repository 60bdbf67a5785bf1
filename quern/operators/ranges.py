"""Sequences that no task sees whole: sorted ranges, and what one range hands to the next (survey W09, W17, M11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import use_checkpoints

Batches = Iterator[pa.RecordBatch]


def sorted_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df sorted as a whole, in as many ranges as the session has shuffle partitions, ties dealt by where they come from.

    __range and __at are a row's range and its place there from 0; they are written, so they stay what they are.
    """
    use_checkpoints(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "__tie"]
    held = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__tie")
    id_ = F.monotonically_increasing_id()
    return held.select("*", F.shiftright(id_, 33).cast("int").alias("__range"), id_.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")).checkpoint()


def group_starts(batch: pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Where a row's group is another than that of the row before; false for the first row. Null is a group like any other."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        here, before = batch.column(c)[1:], batch.column(c)[:-1]
        differs = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
        new[1:] |= differs | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return new


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the maps y -> a y + b, each applied after all before it: factors and terms, in log n passes over the arrays."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return a, b


def _local(by: Sequence[str]) -> Callable[[Batches], Batches]:
    """Each row's value as factor * (value of its range's first row) + term."""

    def scan(batches: Batches) -> Batches:
        key, carried = None, (1.0, 0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, start = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("__a", "__b", "__start"))
            new = group_starts(batch, by)
            first = [batch.column(c)[0].as_py() for c in by]
            if key is None:
                a[0], b[0] = 1.0, 0.0
            elif first != key:
                new[0] = True
            a, b = np.where(new, 0.0, a), np.where(new, start, b)
            factor, term = composed(a, b)
            term, factor = factor * carried[1] + term, factor * carried[0]
            key, carried = [batch.column(c)[-1].as_py() for c in by], (factor[-1], term[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(factor), pa.array(term)], names=[*batch.schema.names, "__factor", "__term"])

    return scan


def scan(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], a: Column, b: Column, start: Column, out: str) -> DataFrame:
    """Add out, a recurrence along each group: start in its first row, a * (the row before's) + b in the others.

    A parallel prefix over affine maps: each sorted range is reduced to one map, the maps are applied to each other
    in turn (a row for each range comes to the driver), and every row takes its range's first value. A group of any length is
    spread over many ranges, and the rows are shuffled once. A row whose a or b is null leaves the value as it is; a null start is 0.
    """
    held = df.select("*", F.when(b.isNull(), 1.0).otherwise(F.coalesce(a, F.lit(1.0))).cast("double").alias("__a"), F.when(a.isNull(), 0.0).otherwise(F.coalesce(b, F.lit(0.0))).cast("double").alias("__b"), F.coalesce(start, F.lit(0.0)).cast("double").alias("__start"))
    rows = sorted_ranges(held, [*[F.asc_nulls_first(c) for c in by], *order])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.mapInArrow(_local(by), f"{fields}, __factor double, __term double").checkpoint()
    key = F.struct(*by) if by else F.lit(0)
    ends = rows.groupBy("__range").agg(
        *[F.min_by(c, "__at").alias(n) for c, n in ((key, "first"), (F.col("__a"), "a"), (F.col("__b"), "b"), (F.col("__start"), "start"))], *[F.max_by(c, "__at").alias(n) for c, n in ((key, "last"), (F.col("__factor"), "factor"), (F.col("__term"), "term"))]
    )
    firsts, group, value = [], None, 0.0
    for i, r in enumerate(sorted(ends.collect(), key=lambda r: r["__range"])):
        head = r.a * value + r.b if i and r.first == group else r.start
        firsts.append((r["__range"], head))
        group, value = r.last, r.factor * head + r.term
    heads = F.broadcast(df.sparkSession.createDataFrame(firsts, "__range int, __head double"))
    return rows.join(heads, "__range").select(*df.columns, (F.col("__factor") * F.col("__head") + F.col("__term")).alias(out))


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], x: Column, out: str) -> DataFrame:
    """Add out, the sum of x up to each row of its group; nulls add nothing."""
    return scan(df, by, order, F.lit(1.0), x, x, out)


def exponential_smoothing(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], x: Column, alpha: float, out: str) -> DataFrame:
    """Add out: the first x of a group, then alpha times x and 1 - alpha times what was before; a null x changes nothing."""
    return scan(df, by, order, F.lit(1.0 - alpha), F.lit(alpha) * x, x, out)


def autoregressive(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], x: Column, a: float, b: float, out: str) -> DataFrame:
    """Add out: w[0] = x[0], w[k] = a w[k-1] + b x[k] along each group."""
    return scan(df, by, order, F.lit(a), F.lit(b) * x, x, out)
