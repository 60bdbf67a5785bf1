"""A KD-tree of distributed medians: even leaves of near points, and boxes that leave leaves unread (survey O05, J09)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .checkpoints import use_checkpoints
from .selection import order_statistics


@dataclass
class Tree:
    """Splits level by level: of each node its axis, the last value that goes left, and the last key of that value that does."""

    axes: Sequence[str]
    key: str
    splits: list[list[tuple[int, float, int]]] = field(default_factory=list)

    @property
    def leaves(self) -> int:
        return 1 << len(self.splits)

    def place(self, points: DataFrame, out: str = "leaf") -> DataFrame:
        """points with the number of their leaf, by look-ups in arrays of one number a node; nothing is joined."""
        axes, key, names = list(self.axes), self.key, points.columns
        levels = [[np.array(x) for x in zip(*level, strict=True)] for level in self.splits]

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(a).cast(pa.float64()).to_numpy(zero_copy_only=False) for a in axes])
                keys, node = batch.column(key).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int64)
                for axis, at, last in levels:
                    value = x[axis[node], np.arange(batch.num_rows)]
                    node = 2 * node + ((value > at[node]) | ((value == at[node]) & (keys > last[node])))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(node, pa.int32())], names=[*names, out])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
        return points.mapInArrow(walk, f"{fields}, `{out}` int")


def build(points: DataFrame, key: str, axes: Sequence[str], depth: int) -> Tree:
    """2^depth leaves whose sizes differ by one row at each level at most, whatever the points' density.

    A level splits each node at the median of its widest axis: two aggregations and an exact selection by counting, so no task
    sorts a node, let alone the root. Points of equal value are told by key, an integer without repeats. depth is a
    parameter, so the splits on the driver have a known size. Points with a null or NaN coordinate aren't counted.
    """
    use_checkpoints(points.sparkSession)
    held = points.select(F.col(key).cast("long").alias(key), *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    for a in axes:
        held = held.where(~F.isnan(a))
    tree = Tree(axes, key)
    for level in range(depth):
        here = tree.place(held, "__node")
        extents = here.groupBy("__node").agg(F.count(F.lit(1)).alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in axes]).collect()  # a row for each node
        widest = {r["__node"]: max(range(len(axes)), key=lambda k, r=r: (r[axes[k]], -k)) for r in extents}
        spark = points.sparkSession
        numbers = spark.createDataFrame(list(widest.items()), "__node int, __axis int")
        here = here.join(F.broadcast(numbers), "__node").select("__node", key, F.element_at(F.array(*[F.col(a) for a in axes]), F.col("__axis") + 1).alias("__v"))
        ranks = spark.createDataFrame([(r["__node"], (r.n - 1) // 2) for r in extents], "__node int, __rank long")
        middle = {r["__node"]: r["__value"] for r in order_statistics(here, ["__node"], "__v", ranks).collect()}
        here = here.join(F.broadcast(spark.createDataFrame(list(middle.items()), "__node int, __at double")), "__node")
        at = F.col("__at")
        equal = F.col("__v") == at
        ties = {r["__node"]: r for r in here.groupBy("__node").agg(F.count_if(F.col("__v") < at).alias("less"), F.count_if(equal).alias("equal"), F.max(F.when(equal, F.col(key))).alias("last")).collect()}
        # of several points on the border as many go left as the rank says, those with the least keys
        cut = [(i, (r.n - 1) // 2 - ties[i].less) for r in extents if (i := r["__node"]) in ties and ties[i].equal > 1]
        last = {i: t.last for i, t in ties.items()}
        if cut:
            keys = here.where(equal).select("__node", F.col(key).cast("double").alias("__key"))
            last |= {r["__node"]: int(r["__value"]) for r in order_statistics(keys, ["__node"], "__key", spark.createDataFrame(cut, "__node int, __rank long")).collect()}
        tree.splits.append([(widest.get(i, 0), middle.get(i, 0.0), last.get(i, 0)) for i in range(1 << level)])
    return tree


def boxes(placed: DataFrame, axes: Sequence[str], leaf: str = "leaf") -> dict[int, list[tuple[float, float]]]:
    """The bounds of each leaf's points; a row for each leaf comes to the driver."""
    found = placed.groupBy(leaf).agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(axes) for n, f in (("low", F.min), ("high", F.max))]).collect()
    return {r[leaf]: [(r[f"low{i}"], r[f"high{i}"]) for i in range(len(axes))] for r in found}


def write_leaves(placed: DataFrame, path: str, leaf: str = "leaf") -> None:
    """A folder for each leaf; a leaf's rows meet in one task, which holds 1 / 2^depth of all."""
    placed.repartition(leaf).write.partitionBy(leaf).parquet(path)


def within(axes: Sequence[str], low: Sequence[float], high: Sequence[float]) -> Column:
    inside = F.lit(True)
    for a, x, y in zip(axes, low, high, strict=True):
        inside = inside & F.col(a).between(float(x), float(y))
    return inside


def read_box(spark: SparkSession, path: str, bounds: dict[int, list[tuple[float, float]]], axes: Sequence[str], low: Sequence[float], high: Sequence[float], leaf: str = "leaf") -> DataFrame:
    """The points in a box, from the leaves alone whose bounds it meets: the others' files aren't opened."""
    met = [i for i, box in bounds.items() if all(b >= x and a <= y for (a, b), x, y in zip(box, low, high, strict=True))]
    return spark.read.parquet(path).where(F.col(leaf).isin(met) & within(axes, low, high))
