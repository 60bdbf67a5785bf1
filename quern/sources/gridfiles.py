"""Dense array files that tasks read and write in place: npy, npz, raw memory maps and classic netCDF (survey S07, K04, K06, K08).

A file has one place for each value, so each task reads its own rows, and writers let each task put its values where they
belong, in a file beside the target that one commit puts in place. Paths are on a file system that driver and executors share.
"""

from __future__ import annotations

import os
import shutil
import struct
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .committed import Array, staging, write_arrays

#: Values that one task reads.
SLAB = 1 << 22


def plain(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


# ---------------------------------------------------------------- writers


def memmap(df: DataFrame, path: str, indexes: Sequence[str], value: str, shape: tuple[int, ...], dtype: str = "<f4") -> None:
    """A raw array in C order; places that no row has are zeros, or what a file of that size held there before."""
    path, size = plain(path), int(np.prod(shape, dtype=np.int64)) * np.dtype(dtype).itemsize
    staged = staging(path)
    if os.path.exists(path) and os.path.getsize(path) == size:
        shutil.copyfile(path, staged)
    else:
        with open(staged, "wb") as out:
            out.truncate(size)
    write_arrays(df, indexes, [Array(value, dtype, 0, shape)], staged, path)


def npy(df: DataFrame, path: str, indexes: Sequence[str], value: str, shape: tuple[int, ...], dtype: str = "<f8") -> None:
    path = plain(path)
    made = np.lib.format.open_memmap(staged := staging(path), "w+", dtype, shape)
    offset = made.offset
    del made
    write_arrays(df, indexes, [Array(value, dtype, offset, shape)], staged, path)


def npz(arrays: Mapping[str, tuple[DataFrame, Sequence[str], str, tuple[int, ...]]], path: str, dtype: str = "<f8") -> None:
    """Named arrays, each (rows, index columns, value column, shape), compressed in one file; each passes through the disk, not the driver's memory."""
    path = plain(path)
    staged = staging(path)
    try:
        with zipfile.ZipFile(staged, "w", zipfile.ZIP_DEFLATED) as out:
            for name, (df, indexes, value, shape) in arrays.items():
                npy(df, part := f"{staged}.{name}.npy", indexes, value, shape, dtype)
                out.write(part, f"{name}.npy")
                os.remove(part)
        os.replace(staged, path)
    finally:
        if os.path.exists(staged):
            os.remove(staged)


# ---------------------------------------------------------------- classic netCDF

#: Tags and types of the format.
DIMENSION, VARIABLE, ATTRIBUTE = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: int
    begin: int = 0
    record: bool = False
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    dims: dict[str, int]
    variables: dict[str, Variable]
    attributes: dict
    records: int = 0
    record_size: int = 0

    def shape(self, name: str) -> tuple[int, ...]:
        v = self.variables[name]
        return tuple(self.records if v.record and i == 0 else self.dims[d] for i, d in enumerate(v.dims))


class _Bytes:
    def __init__(self, source, wide: bool = False) -> None:  # noqa: ANN001
        self.source, self.wide = source, wide

    def number(self, size: int = 4) -> int:
        return int.from_bytes(self.source.read(size), "big")

    def count(self) -> int:
        return self.number(8 if self.wide else 4)

    def text(self) -> str:
        n = self.count()
        return self.source.read(-(-n // 4) * 4)[:n].decode()

    def attributes(self) -> dict:
        self.number()
        out = {}
        for _ in range(self.count()):
            name, kind, n = self.text(), self.number(), self.count()
            size = n * np.dtype(TYPES[kind]).itemsize
            raw = self.source.read(-(-size // 4) * 4)[:size]
            values = raw.decode() if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
            out[name] = values[0] if isinstance(values, list) and len(values) == 1 else values
        return out


def read_header(path: str) -> Header:
    """Of a file of the classic format, of 32-bit or 64-bit offsets or 64-bit data."""
    with open(plain(path), "rb") as source:
        magic = source.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError(f"{path} is no classic netCDF file")
        r = _Bytes(source, magic[3] == 5)
        records = r.count()
        r.number()
        names, dims, record_dim = [], {}, None
        for _ in range(r.count()):
            names.append(name := r.text())
            dims[name] = r.count()
            record_dim = name if not dims[name] else record_dim
        attributes = r.attributes()
        r.number()
        variables = {}
        for _ in range(r.count()):
            name = r.text()
            own = tuple(names[r.count()] for _ in range(r.count()))
            about, kind, _ = r.attributes(), r.number(), r.count()
            variables[name] = Variable(name, own, kind, r.number(4 if magic[3] == 1 else 8), bool(own) and own[0] == record_dim, about)
    header = Header(dims, variables, attributes, records)
    sizes = [int(np.prod([dims[d] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize for v in variables.values() if v.record]
    header.record_size = sizes[0] if len(sizes) == 1 else sum(-(-s // 4) * 4 for s in sizes)
    return header


def _write_header(path: str, header: Header) -> None:
    """64-bit offsets; sets where each variable begins, and the file's full size."""

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">i", len(raw)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attribute(name: str, value: object) -> bytes:
        if isinstance(value, str):
            return text(name) + struct.pack(">i", 2) + text(value)
        values = np.atleast_1d(value)
        kind = 4 if values.dtype.kind in "iu" else 6
        raw = values.astype(TYPES[kind]).tobytes()
        return text(name) + struct.pack(">ii", kind, len(values)) + raw.ljust(-(-len(raw) // 4) * 4, b"\0")

    def built() -> bytes:
        order = list(header.dims)
        dims = listed(DIMENSION, [text(d) + struct.pack(">i", n) for d, n in header.dims.items()])
        about = listed(ATTRIBUTE, [attribute(*a) for a in header.attributes.items()])
        own = []
        for v in header.variables.values():
            size = size_of(v)
            own.append(text(v.name) + struct.pack(f">i{len(v.dims)}i", len(v.dims), *[order.index(d) for d in v.dims]) + listed(ATTRIBUTE, [attribute(*a) for a in v.attributes.items()]) + struct.pack(">iIq", v.kind, min(size, (1 << 32) - 1), v.begin))
        return b"CDF\2" + struct.pack(">i", 0) + dims + about + listed(VARIABLE, own)

    def size_of(v: Variable) -> int:
        return -(-int(np.prod([header.dims[d] for d in v.dims], dtype=np.int64)) * np.dtype(TYPES[v.kind]).itemsize // 4) * 4

    at = len(built())
    for v in header.variables.values():
        v.begin, at = at, at + size_of(v)
    with open(path, "wb") as out:
        out.write(built())
        out.truncate(at)


def netcdf(df: DataFrame, path: str, dims: Mapping[str, int], variables: Mapping[str, Mapping], coordinates: Mapping[str, Sequence[float]] | None = None, attributes: Mapping | None = None, kind: int = 5) -> None:
    """Rows (dims..., variables...) as a classic netCDF file of fixed dimensions; dims are index columns with their lengths.

    variables and coordinates get the attributes given for them; values are floats of type `kind`. Places without a row are zeros.
    """
    path = plain(path)
    staged = staging(path)
    found = {c: Variable(c, (c,), 6) for c in coordinates or {}} | {v: Variable(v, tuple(dims), kind, attributes=dict(about)) for v, about in variables.items()}
    header = Header(dict(dims), found, dict(attributes or {}))
    _write_header(staged, header)
    for c, values in (coordinates or {}).items():
        np.memmap(staged, TYPES[6], "r+", found[c].begin, (dims[c],))[:] = values
    write_arrays(df, list(dims), [Array(v, TYPES[kind], found[v].begin, tuple(dims.values())) for v in variables], staged, path)


class _Slab(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


def _labels(dims: Sequence[str], variables: Sequence[str]) -> list[str]:
    """Names of index columns: a dimension's own, unless a variable that is read has it too."""
    return [f"{d}_index" if d in variables else d for d in dims]


class NetcdfDataSource(DataSource):
    """spark.read.format("netcdf").option("variables", "a,b").load(path): (dims... long, variables... double).

    The variables share their dimensions, and only they are read; a task reads whole rows of the first dimension, or those
    of a hyperslab that options like lat = 3:7 cut out of the others.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def _names(self) -> list[str]:
        return [v.strip() for v in self.options["variables"].split(",")]

    def schema(self) -> str:
        header = read_header(self.options["path"])
        shared = {header.variables[v].dims for v in self._names()}
        if len(shared) != 1:
            raise ValueError(f"variables of different dimensions: {sorted(shared)}")
        return ", ".join([*(f"`{d}` long" for d in _labels(shared.pop(), self._names())), *(f"`{v}` double" for v in self._names())])

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _NetcdfReader(dict(self.options), self._names())


class _NetcdfReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]) -> None:
        self.path, self.names, self.header = plain(options["path"]), names, read_header(options["path"])
        self.dims, self.shape = self.header.variables[names[0]].dims, self.header.shape(names[0])
        self.cut = []
        for d, n in zip(self.dims, self.shape, strict=True):
            low, high = (options.get(d.lower(), f"0:{n}") + ":").split(":")[:2]
            self.cut.append(slice(int(low), min(n, int(high or int(low) + 1))))

    def partitions(self) -> list[InputPartition]:
        each = max(1, SLAB // max(1, int(np.prod(self.shape[1:], dtype=np.int64))))
        first = self.cut[0]
        return [_Slab(i, min(first.stop, i + each)) for i in range(first.start, first.stop, each)]

    def _array(self, name: str) -> np.ndarray:
        v, shape = self.header.variables[name], self.shape
        if not v.record:
            return np.memmap(self.path, TYPES[v.kind], "r", v.begin, shape)
        inner = np.dtype((np.dtype(TYPES[v.kind]), shape[1:]))
        row = np.dtype({"names": ["v"], "formats": [inner], "offsets": [0], "itemsize": max(inner.itemsize, self.header.record_size)})
        if not shape[0]:
            return np.zeros(shape)
        held = np.memmap(self.path, np.uint8, "r", v.begin)
        return np.ndarray(shape[0], row, held, 0, (row.itemsize,))["v"] if len(held) >= shape[0] * row.itemsize else _records(held, shape, inner, self.header.record_size)

    def read(self, partition: _Slab) -> Iterator[pa.RecordBatch]:
        cut = (slice(partition.start, partition.stop), *self.cut[1:])
        at = np.meshgrid(*[np.arange(c.start, c.stop) for c in cut], indexing="ij")
        values = [np.asarray(self._array(v)[cut], np.float64).ravel() for v in self.names]
        yield pa.RecordBatch.from_arrays([*(pa.array(i.ravel()) for i in at), *(pa.array(v) for v in values)], names=[*_labels(self.dims, self.names), *self.names])


def _records(held: np.ndarray, shape: tuple[int, ...], inner: np.dtype, size: int) -> np.ndarray:
    """The last variable of a record ends before the record does: its rows one by one."""
    return np.stack([np.frombuffer(held[i * size : i * size + inner.itemsize].tobytes(), inner.base).reshape(shape[1:]) for i in range(shape[0])])


def read_netcdf(spark: SparkSession, path: str, variables: Sequence[str], **cut: str) -> DataFrame:
    """The variables of a file as rows; cut: dimension = "start:stop"."""
    spark.dataSource.register(NetcdfDataSource)
    reader = spark.read.format("netcdf").option("variables", ",".join(variables))
    for dim, part in cut.items():
        reader = reader.option(dim, part)
    return reader.load(path)
