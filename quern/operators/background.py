"""Jobs that run beside the caller: futures, persists in the background, profiles and rates (survey T05-T07, Y14, Y15, A26)."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


class Background:
    """Runs actions on threads of the driver, so that Spark runs their jobs side by side; as a context it waits for them all.

    A thread has the session's properties (pool, job group) of the caller. `at_once` bounds the jobs in flight.
    """

    def __init__(self, spark: SparkSession, at_once: int = 4) -> None:
        self.spark, self.pool = spark, ThreadPoolExecutor(at_once, "quern")

    def __enter__(self) -> Background:
        return self

    def __exit__(self, *_: object) -> None:
        self.pool.shutdown(wait=True)

    def submit(self, action: Callable[[], Any]) -> Future:
        """The action's result, some time."""
        return self.pool.submit(inheritable_thread_target(self.spark)(action))

    def persist(self, df: DataFrame) -> tuple[DataFrame, Future]:
        """df, marked to be kept, and its row count once it is: work on it may begin before."""
        kept = df.persist()
        return kept, self.submit(kept.count)


def gather(futures: Iterable[Future]) -> list:
    """Results in the order asked for; the first failure is raised."""
    return [f.result() for f in futures]


@dataclass
class Profile:
    """Calls, seconds and rows by name."""

    calls: dict[str, int] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def measured(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.calls[name] = self.calls.get(name, 0) + 1
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def __call__(self, f: Callable) -> Callable:
        """A decorator: what f takes; if it returns a table, the rows too, counted by running it."""

        @functools.wraps(f)
        def run(*args: object, **options: object) -> object:
            with self.measured(f.__name__):
                out = f(*args, **options)
                if isinstance(out, DataFrame):
                    self.rows[f.__name__] = self.rows.get(f.__name__, 0) + out.count()
            return out

        return run

    def rate(self, name: str, work: float) -> float:
        """Units of work a second, over all calls of that name."""
        return work * self.calls[name] / max(self.seconds[name], 1e-9)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, self.calls[n], self.seconds[n], self.rows.get(n)) for n in self.calls]
        return spark.createDataFrame(rows, "name string, calls long, seconds double, rows long")
