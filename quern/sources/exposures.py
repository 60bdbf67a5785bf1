"""Exposures of many detectors: FITS and HDF5 data sources of our own, and a Parquet layout by detector (survey S14-S18, R18)."""

from __future__ import annotations

import abc
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import header_name, padded_header
from ..operators.checkpoints import use_checkpoints
from . import hdf5
from .committed import staging, write_blocks

BLOCK, CARD = 2880, 80
#: Fixed values of the format: bits of a pixel and NumPy's name of its type.
TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
ROW = "hdu int, header map<string,string>, y int, v array<double>"


def _header(file) -> dict[str, str] | None:  # noqa: ANN001
    """The cards of the header that starts here, values without quotes and comments; None at the end of the file."""
    cards: dict[str, str] = {}
    while block := file.read(BLOCK):
        for at in range(0, len(block), CARD):
            card = block[at : at + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards
            if card[8:10] == "= ":
                value = card[10:].strip()
                cards[key] = value[1:].split("'")[0].rstrip() if value.startswith("'") else value.split("/")[0].strip()
    return None


def _size(cards: dict[str, str]) -> int:
    axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
    data = abs(int(cards["BITPIX"])) // 8 * int(np.prod(axes)) if axes else 0
    return data + int(cards.get("PCOUNT", 0)) * abs(int(cards.get("BITPIX", 8))) // 8


class _Hdu(InputPartition):
    def __init__(self, path: str, number: int, at: int, cards: dict[str, str]) -> None:
        self.path, self.number, self.at, self.cards = path, number, at, cards


class FitsDataSource(DataSource):
    """spark.read.format("fits").load(path): ROW for each line of each two-dimensional image, a task for each HDU.

    offset and step choose HDUs, as in files that interleave planes: offset, offset + step, ... The path must be
    visible to the driver and executors alike, as the format is read by seeking.
    """

    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _FitsReader(self.options)


class _FitsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.offset, self.step = options["path"], int(options.get("offset", 0)), int(options.get("step", 1))
        if self.offset < 0 or self.step < 1:
            raise ValueError("offset must be 0 or more and step 1 or more")

    def partitions(self) -> list[InputPartition]:
        found = []
        with open(self.path, "rb") as file:
            while (cards := _header(file)) is not None:
                at = file.tell()
                if int(cards.get("NAXIS", 0)) == 2:
                    found.append(_Hdu(self.path, len(found), at, cards))
                file.seek(at + -(-_size(cards) // BLOCK) * BLOCK)
        return found[self.offset :: self.step]

    def read(self, hdu: _Hdu) -> Iterator[tuple]:
        nx, ny = int(hdu.cards["NAXIS1"]), int(hdu.cards["NAXIS2"])
        kind = np.dtype(TYPES[int(hdu.cards["BITPIX"])])
        scale, zero = float(hdu.cards.get("BSCALE", 1)), float(hdu.cards.get("BZERO", 0))
        with open(hdu.path, "rb") as file:
            file.seek(hdu.at)
            for y in range(ny):
                row = np.frombuffer(file.read(nx * kind.itemsize), kind).astype(np.float64) * scale + zero
                yield hdu.number, hdu.cards, y, row.tolist()


class ExposureSource(abc.ABC):
    """What an exposure gives, whatever holds it."""

    @abc.abstractmethod
    def detectors(self) -> DataFrame:
        """(det_num, det_id, header, nx, ny)."""

    @abc.abstractmethod
    def pixels(self, *detectors: int) -> DataFrame:
        """(det_num, y, x, planes...) of the given detectors, or of all."""


class FitsExposure(ExposureSource):
    """Planes interleaved in one file: HDU 3 k + p holds plane p of detector k."""

    def __init__(self, spark: SparkSession, path: str, planes: tuple[str, ...] = ("sci", "rms", "flg")) -> None:
        spark.dataSource.register(FitsDataSource)
        self.planes = planes
        read = lambda offset: spark.read.format("fits").option("offset", offset).option("step", len(planes)).load(path)
        self.parts = [read(i).withColumn("det_num", F.expr(f"hdu div {len(planes)}")) for i in range(len(planes))]

    def detectors(self) -> DataFrame:
        lines = self.parts[0].groupBy("det_num").agg(F.first("header").alias("header"), F.max(F.size("v")).alias("nx"), (F.max("y") + 1).alias("ny"))
        return lines.select("det_num", header_name(F.col("header")).alias("det_id"), padded_header(F.col("header")).alias("header"), "nx", "ny")

    def pixels(self, *detectors: int) -> DataFrame:
        out = None
        for plane, part in zip(self.planes, self.parts, strict=True):
            chosen = part.where(F.col("det_num").isin(*detectors)) if detectors else part
            cells = chosen.select("det_num", "y", F.posexplode("v").alias("x", plane))
            out = cells if out is None else out.join(cells, ["det_num", "y", "x"])
        return out


class ParquetExposure(ExposureSource):
    """Files by detector, rows in order: a detector is read without the others, a cut-out without most row groups."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @staticmethod
    def write(source: ExposureSource, path: str) -> None:
        source.detectors().write.parquet(f"{path}/detectors")
        source.pixels().repartition("det_num").sortWithinPartitions("y", "x").write.partitionBy("det_num").parquet(f"{path}/pixels")

    def detectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/detectors")

    def pixels(self, *detectors: int) -> DataFrame:
        every = self.spark.read.parquet(f"{self.path}/pixels")
        return every.where(F.col("det_num").isin(*detectors)) if detectors else every


# ---------------------------------------------------------------- HDF5


class Hdf5ExposureDataSource(DataSource):
    """spark.read.format("hdf5_exposure").option("planes", "sci,rms,flg").load(path): (det_num, y, x, planes...), a task a detector.

    The file has the detectors' names as a JSON list in its attribute det_list, and a group of planes for each. option
    detectors = "3,5" reads those numbers alone.
    """

    @classmethod
    def name(cls) -> str:
        return "hdf5_exposure"

    def schema(self) -> str:
        return "det_num int, y int, x int, " + ", ".join(f"{p} double" for p in self.options["planes"].split(","))

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Hdf5ExposureReader(dict(self.options))


class _Detector(InputPartition):
    def __init__(self, number: int, name: str) -> None:
        self.number, self.name = number, name


class _Hdf5ExposureReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.planes = options["path"], options["planes"].split(",")
        self.only = {int(d) for d in options["detectors"].split(",")} if options.get("detectors") else None

    def partitions(self) -> list[InputPartition]:
        file = hdf5.Reader(self.path)
        names = json.loads(file.attributes(file.root)["det_list"])
        return [_Detector(i, n) for i, n in enumerate(names) if self.only is None or i in self.only] or [_Detector(-1, "")]

    def read(self, partition: _Detector) -> Iterator[pa.RecordBatch]:
        if partition.number < 0:
            return
        file = hdf5.Reader(self.path)
        planes = [file.dataset(f"{partition.name}/{p}") for p in self.planes]
        others = [{place: (address, size) for place, address, size in file.chunks(d)} for d in planes[1:]]
        for place, address, size in sorted(file.chunks(planes[0])):
            values = [file.values(planes[0], place, address, size)]
            for d, chunks in zip(planes[1:], others, strict=True):
                if place not in chunks:
                    raise ValueError(f"planes of {partition.name} are not cut alike")
                values.append(file.values(d, place, *chunks[place]))
            y, x = np.indices(values[0].shape)
            columns = [pa.array(np.full(y.size, partition.number), pa.int32()), pa.array((y + place[0]).ravel(), pa.int32()), pa.array((x + place[1]).ravel(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v.astype(np.float64).ravel()) for v in values)], names=["det_num", "y", "x", *self.planes])


class Hdf5Exposure(ExposureSource):
    """One HDF5 file: a group for each detector, a chunked dataset for each of its planes, names and headers as attributes."""

    def __init__(self, spark: SparkSession, path: str, planes: tuple[str, ...] = ("sci", "rms", "flg")) -> None:
        spark.dataSource.register(Hdf5ExposureDataSource)
        self.spark, self.path, self.planes = spark, path, planes

    @staticmethod
    def write(source: ExposureSource, path: str, planes: tuple[str, ...] = ("sci", "rms", "flg"), chunk: tuple[int, int] = (512, 512)) -> None:
        """Executors build and compress the chunks and write each at its address; the driver writes groups and indexes."""
        use_checkpoints(source.pixels().sparkSession)
        detectors = sorted(source.detectors().collect(), key=lambda r: r["det_num"])
        about = {r["det_num"]: r for r in detectors}
        cells = source.pixels().select("det_num", "y", "x", F.explode(F.array(*[F.struct(F.lit(i).alias("plane"), F.col(p).cast("double").alias("v")) for i, p in enumerate(planes)])).alias("p"))
        whole = {r["det_num"]: (r["ny"], r["nx"]) for r in detectors}
        packed = hdf5.packed_chunks(cells.select("det_num", "p.plane", "y", "x", "p.v"), ("det_num", "plane", "y", "x"), "v", (1, 1, *chunk), "<f4", 4).checkpoint()
        out, groups, members = hdf5.Writer(staged := staging(hdf5.plain(path))), {}, {}
        placed, blocks = hdf5.laid_out(out, packed, ("c0", "c1", "c2", "c3"))
        for (det, plane), part in itertools.groupby(placed, key=lambda p: (p[0]["c0"], p[0]["c1"])):
            entries = [((r["c2"] * chunk[0], r["c3"] * chunk[1]), size, address) for r, size, address in part]
            members.setdefault(det, {})[planes[plane]] = out.dataset(whole[det], "<f4", chunk, entries)
        for det, held in members.items():
            groups[about[det]["det_id"]] = out.group(held, {"header": json.dumps(about[det]["header"])})
        out.close(out.group(groups, {"det_list": json.dumps([about[d]["det_id"] for d in sorted(members)])}))
        write_blocks(blocks, staged, hdf5.plain(path))

    def detectors(self) -> DataFrame:
        file = hdf5.Reader(self.path)
        rows = []
        for i, name in enumerate(json.loads(file.attributes(file.root)["det_list"])):
            ny, nx = file.dataset(f"{name}/{self.planes[0]}").shape
            header = json.loads(file.attributes(file.find(name)).get("header", "{}"))
            rows.append((i, name, header, nx, ny))
        return self.spark.createDataFrame(rows, "det_num int, det_id string, header map<string,string>, nx int, ny int")

    def pixels(self, *detectors: int) -> DataFrame:
        reader = self.spark.read.format("hdf5_exposure").option("planes", ",".join(self.planes))
        return (reader.option("detectors", ",".join(map(str, detectors))) if detectors else reader).load(self.path)
