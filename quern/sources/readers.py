"""Readers with declared schemas, and Python data sources for FASTA and NumPy files (survey S01-S19)."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schemas


def csv(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header; `nan` is NaN, not null; globs and lists of paths work."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").option("sep", sep).csv(path)


def tsv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    return csv(spark, path, schema, "\t")


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): records split at '>', so a file is read in parallel; lines of a sequence are joined, blank ones skipped."""
    records = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", "\r?\n")
    body = F.array_join(F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.trim(x)), "")
    return records.select(F.trim(F.get(lines, F.lit(0))).alias("name"), body.alias("seq"))


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, stop) of a JSON object name -> [start, stop]."""
    whole = spark.read.option("wholetext", True).text(path)
    entries = whole.select(F.explode(F.from_json("value", "map<string,array<int>>")))
    return entries.select(F.col("key").alias("name"), F.get("value", F.lit(0)).alias("start"), F.get("value", F.lit(1)).alias("stop"))


def batch_list(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """(batch, pos, idx) of a JSON list of lists; a batch number outside it fails."""
    whole = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "array<array<int>>").alias("b"))
    if batch is not None:
        inside = (F.lit(batch) >= 0) & (F.lit(batch) < F.size("b"))
        whole = whole.where(F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit(f"no batch {batch} among "), F.size("b").cast("string"))).cast("boolean")))
    rows = whole.select(F.posexplode("b").alias("batch", "items")).select("batch", F.posexplode("items").alias("pos", "idx"))
    return rows if batch is None else rows.where(F.col("batch") == batch)


def profile_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE).json(path)


def lightcurves_npz(spark: SparkSession, path: str, stars: int | None = None) -> DataFrame:
    """(star_id, t, flux, flux_err) of npz files with a shared time axis; stars keeps the first so many by id."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                with np.load(io.BytesIO(content)) as file:
                    t, flux, error = file["time"], file["flux"], file["flux_err"]
                    for star in range(min(len(flux), stars or len(flux))):
                        yield pd.DataFrame({"star_id": np.int32(star), "t": t, "flux": flux[star], "flux_err": error[star]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, schemas.LIGHTCURVE)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Three of the many columns of a source catalogue in Parquet."""
    return spark.read.parquet(path).select("object_id", "ra", "dec")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int) -> None:
        self.path, self.start, self.stop = path, start, stop


class NpyDataSource(DataSource):
    """spark.read.format("npy").option("rows_per_task", n).load(path): a 2-d .npy file as (i, v array).

    The file is memory-mapped, so each task reads its own rows; the path must be visible to executors.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "i long, v array<double>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _NpyReader(self.options)


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.rows = options["path"], int(options.get("rows_per_task", 65536))

    def partitions(self) -> list[InputPartition]:
        n = len(np.load(self.path, mmap_mode="r"))
        return [_Range(self.path, i, min(n, i + self.rows)) for i in range(0, n, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        rows = np.load(partition.path, mmap_mode="r")[partition.start : partition.stop]
        for i, row in enumerate(rows.astype(np.float64).tolist()):
            yield partition.start + i, row


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyDataSource)
