"""The vocabulary of message passing as partitioning (survey R01-R17, Y12-Y15)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scatter(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Contiguous ranges of the keys over n partitions; remainders are no special case."""
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def placement(df: DataFrame) -> DataFrame:
    """(partition, rows): where rows lie, the nearest thing to a rank report."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("rows"))


def tasks(spark: SparkSession, n: int, f: Callable[[int], float], at_once: int | None = None) -> DataFrame:
    """(i, value) of an arbitrary Python function for i < n: delayed calls, futures and job arrays alike.

    at_once bounds how many run side by side, as a job array's throttle does: there are as many tasks, each calling f one by one.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"i": part["id"], "value": [float(f(int(i))) for i in part["id"]]})

    return spark.range(0, n, 1, at_once or max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(run, "i long, value double")


class Implementations:
    """Implementations of one operator by name, each from the same inputs to a table, checked against a reference and timed."""

    def __init__(self, reference: str, on: tuple[str, ...], value: str) -> None:
        self.reference, self.on, self.value = reference, on, value
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str, f: Callable[..., DataFrame]) -> None:
        if not callable(f):
            raise TypeError(f"{name} is not callable")
        self.known[name] = f

    def run(self, name: str, *inputs) -> DataFrame:  # noqa: ANN002
        if name not in self.known:
            raise KeyError(f"no implementation {name!r}; there are {sorted(self.known)}")
        return self.known[name](*inputs)

    def validate(self, name: str, *inputs) -> bool:  # noqa: ANN002
        from .validate import Tolerance, regression

        found = regression(self.run(self.reference, *inputs), self.run(name, *inputs), self.on, [self.value], {self.value: Tolerance(1e-8, 1e-5)})
        return bool(found.first()["ok"])

    def profile(self, *inputs, names: list[str] | None = None):  # noqa: ANN002, ANN201
        """A Profile of a run of each: calls, seconds, rows."""
        from .background import Profile

        found = Profile()
        for name in names or list(self.known):
            with found.measured(name):
                found.rows[name] = self.run(name, *inputs).count()
        return found

    def benchmark(self, *inputs, names: list[str] | None = None) -> dict[str, float]:  # noqa: ANN002
        seconds = {}
        for name in names or list(self.known):
            began = time.perf_counter()
            self.run(name, *inputs).write.format("noop").mode("overwrite").save()
            seconds[name] = time.perf_counter() - began
        return seconds
