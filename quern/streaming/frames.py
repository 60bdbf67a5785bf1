"""A stream of frames: the row groups of Parquet files, one after the other (survey S08, T01)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class _Frame(InputPartition):
    def __init__(self, path: str, group: int) -> None:
        self.path, self.group = path, group


class FrameDataSource(DataSource):
    """spark.readStream.format("frames").schema(s).load(path): a file, or a folder whose files come in order of their names.

    A frame is a row group. The offset is the number of frames so far, so a query that starts again from its checkpoint
    goes on with the first frame that it hasn't finished, and files that were added behind the last name are read
    then. Each frame is a task that reads its own columns; the driver reads the files' footers alone. The path must be
    visible to executors. Columns that a file lacks are null.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        raise ValueError("give the columns to read with schema()")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FrameReader(self.options["path"], schema)


class _FrameReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path.removeprefix("file://").removeprefix("file:"), schema
        self.groups: dict[str, int] = {}

    def _frames(self) -> list[_Frame]:
        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".parquet"))
        for f in files:
            if f not in self.groups:  # a footer is read once
                self.groups[f] = pq.ParquetFile(f).metadata.num_row_groups
        return [_Frame(f, g) for f in files for g in range(self.groups[f])]

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        return {"frame": len(self._frames())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self._frames()[start["frame"] : end["frame"]]

    def read(self, partition: _Frame) -> Iterator[pa.RecordBatch]:
        schema, file = to_arrow_schema(self.schema), pq.ParquetFile(partition.path)
        held = [f.name for f in schema if f.name in file.schema_arrow.names]
        for batch in file.iter_batches(row_groups=[partition.group], columns=held):
            columns = [batch.column(f.name).cast(f.type) if f.name in held else pa.nulls(batch.num_rows, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameDataSource)
