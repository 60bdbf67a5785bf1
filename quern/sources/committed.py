"""Files that tasks fill side by side and one commit puts in place (survey K04, K06-K08).

The driver lays a file of the final size beside the target, tasks write their values or blocks where they belong in it and
report what they wrote, and the commit step renames it. A task that is run again writes the same bytes; a job that fails
removes the file, and the target is what it was. Values never pass through the driver. Paths are on a file system that
driver and executors share.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class Array:
    """A column's values as an array inside a file, in C order."""

    column: str
    dtype: str
    offset: int
    shape: tuple[int, ...]


@dataclass
class Written(WriterCommitMessage):
    rows: int


class CommittedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return (_Blocks if self.options["what"] == "blocks" else _Arrays)(self.options)


class _Committed(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.staged, self.target = options["staged"], options["target"]

    def commit(self, messages: list[Written]) -> None:
        os.replace(self.staged, self.target)

    def abort(self, messages: list[Written]) -> None:
        if os.path.exists(self.staged):
            os.remove(self.staged)


class _Arrays(_Committed):
    """Rows (index columns, value columns): each value goes to the place of its indexes."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.indexes, self.arrays = json.loads(options["indexes"]), [Array(**a) for a in json.loads(options["arrays"])]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held = [(a.column, np.memmap(self.staged, a.dtype, "r+", a.offset, tuple(a.shape))) for a in self.arrays]
        n = 0
        for batch in iterator:
            at = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in self.indexes)
            for column, out in held:
                out[at] = batch.column(column).to_numpy(zero_copy_only=False)
            n += batch.num_rows
        for _, out in held:
            out.flush()
        return Written(n)


class _Blocks(_Committed):
    """Rows (address, data): bytes at their address."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        with open(self.staged, "r+b") as out:
            for batch in iterator:
                for address, data in zip(batch.column("address").to_pylist(), batch.column("data"), strict=True):
                    out.seek(address)
                    out.write(data.as_buffer())
                n += batch.num_rows
        return Written(n)


def staging(target: str) -> str:
    """A name beside the target."""
    return f"{target}.{uuid.uuid4().hex}.tmp"


def _save(df: DataFrame, staged: str, target: str, **options: str) -> None:
    df.sparkSession.dataSource.register(CommittedDataSource)
    try:
        df.write.format("committed").options(staged=staged, target=target, **options).mode("append").save()
    finally:
        if os.path.exists(staged):  # the job failed before its writer could
            os.remove(staged)


def write_arrays(df: DataFrame, indexes: Sequence[str], arrays: Sequence[Array], staged: str, target: str) -> None:
    """Fill the arrays of the staged file from rows, and put it at target."""
    if not all(np.prod(a.shape, dtype=np.int64) for a in arrays):  # nothing to map
        os.replace(staged, target)
        return
    held = df.select(*indexes, *[a.column for a in arrays])
    _save(held, staged, target, what="arrays", indexes=json.dumps(list(indexes)), arrays=json.dumps([asdict(a) for a in arrays]))


def write_blocks(df: DataFrame, staged: str, target: str) -> None:
    """Put rows (address, data) into the staged file, and that at target."""
    _save(df.select("address", "data"), staged, target, what="blocks")
