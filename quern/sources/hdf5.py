"""HDF5 files with groups, attributes and chunked, compressed datasets (survey S11, S16, K07).

The subset is that of the format's first version, which libraries write unless told otherwise: symbol-table groups,
object headers of version 1, contiguous or chunked layouts with a B-tree, and the deflate and shuffle filters. Paths are
on a file system that driver and executors share.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.checkpoints import use_checkpoints
from .committed import staging, write_blocks
from .gridfiles import SLAB, plain

#: Fixed values of the format: signature, the undefined address, and kinds of header messages.
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
DATASPACE, DATATYPE, FILL, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOLS = 1, 3, 5, 8, 11, 12, 16, 17
#: Entries of a symbol node and children of a group's and of a chunk's tree node: twice the ranks in the superblock.
LEAF, BRANCH, CHUNKS = 8, 32, 64


def _padded(data: bytes) -> bytes:
    return data.ljust(-(-len(data) // 8) * 8, b"\0")


# ---------------------------------------------------------------- types and spaces


def _type_message(dtype: np.dtype) -> bytes:
    size, big = dtype.itemsize, dtype.byteorder == ">"
    if dtype.kind == "S":
        return struct.pack("<B3BI", 0x13, 0x11, 0, 0, size)
    if dtype.kind == "f":
        exponent, mantissa = {4: (8, 23), 8: (11, 52)}[size]
        return struct.pack("<B3BIHHBBBBI", 0x11, 0x20 | big, size * 8 - 1, 0, size, 0, size * 8, mantissa, exponent, 0, mantissa, (1 << exponent - 1) - 1)
    return struct.pack("<B3BIHH", 0x10, (8 if dtype.kind == "i" else 0) | big, 0, 0, size, 0, size * 8)


def _type_of(data: bytes) -> np.dtype:
    kind, low, _, _, size = struct.unpack("<B3BI", data[:8])
    order = ">" if low & 1 and kind & 15 != 3 else "<"
    if kind & 15 == 3:
        return np.dtype(f"S{size}")
    if kind & 15 == 1:
        return np.dtype(f"{order}f{size}")
    if kind & 15 == 0:
        return np.dtype(f"{order}{'i' if low & 8 else 'u'}{size}")
    raise ValueError(f"values of HDF5 class {kind & 15} are not read")


def _space_message(shape: Sequence[int]) -> bytes:
    return struct.pack(f"<BBBB4x{len(shape)}Q", 1, len(shape), 0, 0, *shape)


def _space_of(data: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{data[1]}Q", data, 8 if data[0] == 1 else 4)


# ---------------------------------------------------------------- writing


class Writer:
    """Writes from front to back; groups and the superblock come last, as they hold addresses."""

    def __init__(self, path: str) -> None:
        self.out: BinaryIO = open(plain(path), "wb")  # noqa: SIM115
        self.out.write(b"\0" * 96)

    def _put(self, data: bytes) -> int:
        at = self.out.tell()
        self.out.write(_padded(data))
        return at

    def _header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHB3x", kind, len(_padded(data)), 0) + _padded(data) for kind, data in messages)
        return self._put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    @staticmethod
    def _attributes(attributes: Mapping) -> list[tuple[int, bytes]]:
        out = []
        for name, value in attributes.items():
            array = np.array(value.encode() or b"\0") if isinstance(value, str) else np.array(value)
            label = name.encode() + b"\0"
            kind, space = _type_message(array.dtype), _space_message(array.shape)
            head = struct.pack("<BxHHH", 1, len(label), len(kind), len(space))
            out.append((ATTRIBUTE, head + _padded(label) + _padded(kind) + _padded(space) + array.tobytes()))
        return out

    def reserve(self, size: int) -> int:
        """The address of size bytes that somebody else writes."""
        at = self.out.tell()
        self.out.seek(-(-size // 8) * 8, os.SEEK_CUR)
        return at

    def dataset(self, shape: Sequence[int], dtype: str, chunk: Sequence[int], entries: list[tuple[tuple[int, ...], int, int]], attributes: Mapping | None = None, level: int = 4) -> int:
        """Address of a chunked dataset; entries: (place of the first value, size and address of the deflated chunk), in the order of places."""
        kind = np.dtype(dtype)
        tree = self._tree(entries, chunk)
        layout = struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, 2, len(chunk) + 1, tree, *chunk, kind.itemsize)
        pipeline = struct.pack("<BB6xHHHHI4x", 1, 1, 1, 0, 1, 1, level)
        messages = [(DATASPACE, _space_message(shape)), (DATATYPE, _type_message(kind)), (FILL, struct.pack("<BBBB", 2, 3, 0, 0)), (LAYOUT, layout), (FILTERS, pipeline)]
        return self._header(messages + self._attributes(attributes or {}))

    def _tree(self, entries: list[tuple], chunk: Sequence[int]) -> int:
        if not entries:
            return UNDEFINED
        key = lambda place, size: struct.pack(f"<II{len(chunk) + 1}Q", size, 0, *place, 0)
        end = key((entries[-1][0][0] + chunk[0], *entries[-1][0][1:]), 0)
        rows, level = [(key(place, size), address) for place, size, address in entries], 0
        while True:
            above = []
            for at in range(0, len(rows), CHUNKS):
                part = rows[at : at + CHUNKS]
                last = rows[at + CHUNKS][0] if at + CHUNKS < len(rows) else end
                body = struct.pack("<4sBBHQQ", b"TREE", 1, level, len(part), UNDEFINED, UNDEFINED) + b"".join(k + struct.pack("<Q", a) for k, a in part) + last
                above.append((part[0][0], self._put(body.ljust(24 + CHUNKS * (len(last) + 8) + len(last), b"\0"))))
            rows, level = above, level + 1
            if len(rows) == 1:
                return rows[0][1]

    def group(self, members: Mapping[str, int], attributes: Mapping | None = None) -> int:
        """Address of a group of members by name."""
        names = sorted(members)
        if len(names) > LEAF * BRANCH:
            raise ValueError(f"a group holds {LEAF * BRANCH} members at most")
        heap, offsets = bytearray(8), {}
        for n in names:
            offsets[n] = len(heap)
            heap += _padded(n.encode() + b"\0")
        data = self._put(bytes(heap))
        heap_at = self._put(struct.pack("<4sB3xQQQ", b"HEAP", 0, len(heap), 1, data))
        tree = struct.pack("<Q", 0)
        nodes = 0
        for at in range(0, len(names), LEAF):
            part = names[at : at + LEAF]
            body = struct.pack("<4sBxH", b"SNOD", 1, len(part)) + b"".join(struct.pack("<QQII16x", offsets[n], members[n], 0, 0) for n in part)
            tree += struct.pack("<QQ", self._put(body.ljust(8 + LEAF * 40, b"\0")), offsets[part[-1]])
            nodes += 1
        head = struct.pack("<4sBBHQQ", b"TREE", 0, 0, nodes, UNDEFINED, UNDEFINED)
        tree_at = self._put((head + tree).ljust(24 + (2 * BRANCH + 1) * 8, b"\0"))
        self.links = (tree_at, heap_at)
        return self._header([(SYMBOLS, struct.pack("<QQ", tree_at, heap_at)), *self._attributes(attributes or {})])

    def close(self, root: int) -> None:
        """root: the address of the group that was written last."""
        end = self.out.tell()
        self.out.seek(0)
        self.out.write(SIGNATURE + struct.pack("<BBBxBBBxHHIQQQQ", 0, 0, 0, 0, 8, 8, LEAF // 2, BRANCH // 2, 0, 0, UNDEFINED, end, UNDEFINED))
        self.out.write(struct.pack("<QQIIQQ", 0, root, 1, 0, *self.links))
        self.out.close()


# ---------------------------------------------------------------- reading


@dataclass
class Dataset:
    shape: tuple[int, ...]
    dtype: np.dtype
    chunk: tuple[int, ...] | None
    address: int
    filters: list[tuple[int, tuple[int, ...]]]
    attributes: dict = field(default_factory=dict)


class Reader:
    def __init__(self, path: str) -> None:
        self.file: BinaryIO = open(plain(path), "rb")  # noqa: SIM115
        head = self._at(0, 96)
        if head[:8] != SIGNATURE or head[8] > 1:
            raise ValueError(f"{path} is no HDF5 file with a superblock of version 0 or 1")
        self.root = struct.unpack_from("<Q", head, 64 if head[8] == 0 else 68)[0]

    def _at(self, address: int, size: int) -> bytes:
        self.file.seek(address)
        return self.file.read(size)

    def _messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        version, count, _, size = struct.unpack("<BxHII", self._at(address, 12))
        if version != 1:
            raise ValueError("object headers of later versions are not read")
        blocks = [(address + 16, size)]
        for at, n in blocks:
            data, i = self._at(at, n), 0
            while i + 8 <= len(data) and count:
                kind, length = struct.unpack_from("<HH", data, i)
                body = data[i + 8 : i + 8 + length]
                i, count = i + 8 + length, count - 1
                if kind == CONTINUATION:
                    blocks.append(struct.unpack("<QQ", body[:16]))
                else:
                    yield kind, body

    def _attribute(self, data: bytes) -> tuple[str, object]:
        if data[0] != 1:
            raise ValueError("attributes of later versions are not read")
        sizes, at, parts = struct.unpack_from("<HHH", data, 2), 8, []
        for n in sizes:
            parts.append(data[at : at + n])
            at += -(-n // 8) * 8
        kind, shape = _type_of(parts[1]), _space_of(parts[2])
        array = np.frombuffer(data, kind, int(np.prod(shape, dtype=np.int64)), at).reshape(shape)
        if kind.kind == "S":
            texts = [x.rstrip(b"\0").decode() for x in array.ravel().tolist()]
            return parts[0].rstrip(b"\0").decode(), texts if shape else texts[0]
        return parts[0].rstrip(b"\0").decode(), array.tolist()

    def attributes(self, address: int) -> dict:
        return dict(self._attribute(m) for kind, m in self._messages(address) if kind == ATTRIBUTE)

    def members(self, address: int) -> dict[str, int]:
        """Names and addresses of what a group holds."""
        tree, heap = next(struct.unpack("<QQ", m[:16]) for kind, m in self._messages(address) if kind == SYMBOLS)
        names_at = struct.unpack_from("<Q", self._at(heap, 32), 24)[0]
        found, nodes = {}, [tree]
        for at in nodes:
            if self._at(at, 4) == b"TREE":
                used = struct.unpack("<H", self._at(at + 6, 2))[0]
                nodes += struct.unpack(f"<{2 * used + 1}Q", self._at(at + 24, 16 * used + 8))[1::2]
                continue
            for k in range(struct.unpack("<H", self._at(at + 6, 2))[0]):
                offset, object_at = struct.unpack("<QQ", self._at(at + 8 + 40 * k, 16))
                name = b""
                while b"\0" not in name:
                    name += self._at(names_at + offset + len(name), 64) or b"\0"
                found[name.split(b"\0")[0].decode()] = object_at
        return found

    def find(self, path: str) -> int:
        address = self.root
        for part in filter(None, path.split("/")):
            members = self.members(address)
            if part not in members:
                raise KeyError(f"no {part!r} among {sorted(members)}")
            address = members[part]
        return address

    def dataset(self, path: str) -> Dataset:
        address = self.find(path)
        found = {kind: m for kind, m in self._messages(address) if kind != ATTRIBUTE}
        layout, kind = found[LAYOUT], _type_of(found[DATATYPE])
        if layout[0] != 3 or layout[1] not in (1, 2):
            raise ValueError("layouts other than contiguous or chunked ones of version 3 are not read")
        filters, at = [], 8
        for _ in range(found[FILTERS][1] if FILTERS in found else 0):
            number, name, _, values = struct.unpack_from("<HHHH", found[FILTERS], at)
            at += 8 + -(-name // 8) * 8
            filters.append((number, struct.unpack_from(f"<{values}I", found[FILTERS], at)))
            at += 4 * (values + values % 2)
        if layout[1] == 1:
            return Dataset(_space_of(found[DATASPACE]), kind, None, struct.unpack_from("<Q", layout, 2)[0], [], self.attributes(address))
        rank = layout[2]
        chunk = struct.unpack_from(f"<{rank}I", layout, 11)[:-1]
        return Dataset(_space_of(found[DATASPACE]), kind, chunk, struct.unpack_from("<Q", layout, 3)[0], filters, self.attributes(address))

    def chunks(self, d: Dataset) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(place, address, bytes) of the chunks that were written; of a contiguous dataset, runs of its rows."""
        if d.chunk is None:
            row = int(np.prod(d.shape[1:], dtype=np.int64)) * d.dtype.itemsize
            each = max(1, SLAB * d.dtype.itemsize // max(1, row))
            for i in range(0, d.shape[0] if d.shape and d.address != UNDEFINED else 0, each):
                yield (i, *([0] * (len(d.shape) - 1))), d.address + i * row, min(each, d.shape[0] - i) * row
            return
        nodes = [d.address] if d.address != UNDEFINED else []
        key = 8 + 8 * (len(d.shape) + 1)
        while nodes:
            at = nodes.pop()
            level, used = struct.unpack("<BH", self._at(at + 5, 3))
            body = self._at(at + 24, used * (key + 8))
            for k in range(used):
                size, _, *place = struct.unpack_from(f"<II{len(d.shape)}Q", body, k * (key + 8))
                address = struct.unpack_from("<Q", body, k * (key + 8) + key)[0]
                if level:
                    nodes.append(address)
                else:
                    yield tuple(place), address, size

    def values(self, d: Dataset, place: tuple[int, ...], address: int, size: int) -> np.ndarray:
        """The values of a chunk that lie inside the dataset."""
        data = self._at(address, size)
        for number, arguments in reversed(d.filters):
            if number == 1:
                data = zlib.decompress(data)
            elif number == 2:
                data = np.frombuffer(data, np.uint8).reshape(arguments[0], -1).T.tobytes()
            else:
                raise ValueError(f"filter {number} is not read")
        if d.chunk is None:
            return np.frombuffer(data, d.dtype).reshape(-1, *d.shape[1:])
        whole = np.frombuffer(data, d.dtype, int(np.prod(d.chunk, dtype=np.int64))).reshape(d.chunk)
        return whole[tuple(slice(0, n - p) for n, p in zip(d.shape, place, strict=True))]


# ---------------------------------------------------------------- as tables


class _Part(InputPartition):
    def __init__(self, chunks: list) -> None:
        self.chunks = chunks


class Hdf5DataSource(DataSource):
    """spark.read.format("hdf5").option("dataset", "a/b").load(path): (i0 long, i1 long, ..., v double); a task reads its own chunks.

    Places whose chunk was never written have no row.
    """

    @classmethod
    def name(cls) -> str:
        return "hdf5"

    def schema(self) -> str:
        rank = len(Reader(self.options["path"]).dataset(self.options["dataset"]).shape)
        return ", ".join([*(f"i{k} long" for k in range(rank)), "v double"])

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Hdf5Reader(dict(self.options))


class _Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.dataset = options["path"], options["dataset"]

    def partitions(self) -> list[InputPartition]:
        file = Reader(self.path)
        d = file.dataset(self.dataset)
        chunks = list(file.chunks(d))
        each = max(1, SLAB // max(1, int(np.prod(d.chunk or d.shape, dtype=np.int64))))
        return [_Part(chunks[i : i + each]) for i in range(0, len(chunks), each)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        file = Reader(self.path)
        d = file.dataset(self.dataset)
        for place, address, size in partition.chunks:
            values = file.values(d, place, address, size)
            at = np.indices(values.shape)
            columns = [pa.array((i + p).ravel()) for i, p in zip(at, place, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values.astype(np.float64).ravel())], names=[*(f"i{k}" for k in range(len(place))), "v"])


def read_hdf5(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    spark.dataSource.register(Hdf5DataSource)
    return spark.read.format("hdf5").option("dataset", dataset).load(path)


def packed_chunks(df: DataFrame, indexes: Sequence[str], value: str, chunk: Sequence[int], dtype: str, level: int) -> DataFrame:
    """(c0, c1, ..., data): the deflated chunks of an array given as rows, built a chunk a group."""
    rank = len(indexes)
    at = [F.floor(F.col(c) / n).cast("long").alias(f"c{k}") for k, (c, n) in enumerate(zip(indexes, chunk, strict=True))]
    inside = [F.pmod(F.col(c), F.lit(n)).cast("long").alias(f"o{k}") for k, (c, n) in enumerate(zip(indexes, chunk, strict=True))]

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(tuple(chunk), dtype)
        whole[tuple(rows[f"o{k}"].to_numpy() for k in range(rank))] = rows["v"].to_numpy()
        return pd.DataFrame([(*key, zlib.compress(whole.tobytes(), level))], columns=[*(f"c{k}" for k in range(rank)), "data"])

    names = [f"c{k}" for k in range(rank)]
    return df.select(*at, *inside, F.col(value).alias("v")).groupBy(*names).applyInPandas(lambda key, rows: pack(key, rows), ", ".join([*(f"{n} long" for n in names), "data binary"]))


def laid_out(out: Writer, packed: DataFrame, names: Sequence[str]) -> tuple[list, DataFrame]:
    """Places for packed chunks (names..., data) behind what out holds: (row, size, address) of each in the order of
    names, and (address, data). Sizes alone come to the driver, as many as the index of chunks in the file has entries."""
    found = packed.select(*names, F.octet_length("data").alias("size")).orderBy(*names).collect()
    placed = [(r, r["size"], out.reserve(r["size"])) for r in found]
    kinds = ", ".join(f"{n} long" for n in names)
    addresses = packed.sparkSession.createDataFrame([(*(r[n] for n in names), address) for r, _, address in placed], f"{kinds}, address long")
    return placed, packed.join(addresses, list(names)).select("address", "data")


def hdf5(df: DataFrame, path: str, dataset: str, indexes: Sequence[str], value: str, shape: Sequence[int], chunk: Sequence[int], dtype: str = "<f4", level: int = 4, attributes: Mapping | None = None) -> None:
    """One dataset, at the root, of rows (indexes..., value): executors build and compress the chunks and write each at its
    address; the driver writes the index."""
    use_checkpoints(df.sparkSession)
    names = [f"c{k}" for k in range(len(indexes))]
    packed = packed_chunks(df, indexes, value, chunk, dtype, level).checkpoint()
    out = Writer(staged := staging(plain(path)))
    placed, blocks = laid_out(out, packed, names)
    entries = [(tuple(r[n] * c for n, c in zip(names, chunk, strict=True)), size, address) for r, size, address in placed]
    out.close(out.group({dataset: out.dataset(shape, dtype, chunk, entries, attributes, level)}))
    write_blocks(blocks, staged, plain(path))
