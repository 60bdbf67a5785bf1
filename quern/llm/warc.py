"""WARC records and their fixity: Merkle trees over ordered offset ranges, compared between replicas."""

from __future__ import annotations

import gzip
import hashlib
import os
import re
import sys
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import in_order, stash, table

MIN_FILES, FILE_BYTES = 64, 1 << 30
#: Bytes of a file behind one lowest node of its tree, and children of a node above.
RANGE, FAN = 1 << 16, 16
DATE = "1970-01-01T00:00:00Z"
#: The header around the page's id, its address and the body's length.
HEADER = (
    "WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:",
    f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: ",
    "\r\nContent-Type: text/html\r\nContent-Length: ",
    "\r\n\r\n",
)
END = "\r\n\r\n"


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC resource record as binary; the body is binary."""
    a, b, c, d = HEADER
    parts = [F.lit(a), page_id.cast("string"), F.lit(b), url, F.lit(c), F.octet_length(body).cast("string"), F.lit(d)]
    return F.concat(F.encode(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), "UTF-8"), body, F.encode(F.lit(END), "UTF-8"))


def layout(sizes: DataFrame, min_files: int = MIN_FILES) -> DataFrame:
    """Add file and offset to rows (page_id, digest, length, ...): records of a file stand in the order of page_id, digest.

    Files are dealt by the digest, as many as keep them near FILE_BYTES, so no page, however often it was captured,
    fills one file; only equal records share theirs. Offsets are sums over ranges of the order (file, page_id, digest) and
    within each range, so a file may hold a third of all records.
    """
    total = sizes.select(F.sum("length")).first()[0] or 0
    files = max(min_files, -(-total // FILE_BYTES))
    dealt = sizes.withColumn("file", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % files).cast("int"))
    rows = in_order(dealt, ["file", "page_id", "digest"]).withColumn("__id", F.monotonically_increasing_id())
    rows = stash(rows.withColumn("__part", F.shiftright("__id", 33).cast("int")), "record-order")
    before = Window.partitionBy("file").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file", "__part").agg(F.sum("length").alias("size")).select("file", "__part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("file", "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).join(bases, ["file", "__part"])
    return placed.select(*sizes.columns, "file", (F.col("offset") + F.col("__base")).cast("long").alias("offset"))


def tree(replica: DataFrame, levels: int) -> DataFrame:
    """(file, level, node, digest) of the Merkle trees of all files; replica: (file, offset, page_id, digest).

    A node of level 0 hashes the digests of the records that begin in one range of RANGE bytes, in order;
    a node above hashes those of its FAN children. Each is one aggregation of digests, never of records.
    """

    def above(rows: DataFrame, node: Column, order: list[str]) -> DataFrame:
        kept = F.array_sort(F.collect_list(F.struct(*order, "digest")))
        return rows.groupBy("file", node.alias("node")).agg(F.sha2(F.array_join(F.transform(kept, lambda r: r["digest"]), "").cast("binary"), 256).alias("digest"))

    level = above(replica, F.expr(f"offset div {RANGE}"), ["offset", "page_id"])
    every = level.withColumn("level", F.lit(0))
    for i in range(1, levels + 1):
        level = above(level, F.expr(f"node div {FAN}"), ["node"])
        every = every.unionByName(level.withColumn("level", F.lit(i)))
    return every.select("file", "level", "node", "digest")


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, page_id, status) of the records that differ; both sides (file, offset, page_id, digest).

    Roots are compared first. Level by level only the children of mismatching nodes are compared, on both
    sides, and in the end only the records of mismatching ranges. A record that the other side hasn't at its
    offset is missing, one that only the other side has is extra, one with another digest is changed. Records
    that share an offset and a page_id on one side count as one with the least digest.
    """
    most = ours.select("offset").unionByName(theirs.select("offset")).select(F.max("offset")).first()[0] or 0
    levels, ranges = 0, most // RANGE + 1
    while ranges > 1:
        levels, ranges = levels + 1, -(-ranges // FAN)
    a, b = stash(tree(ours, levels), "tree"), stash(tree(theirs, levels), "tree")
    wrong = None
    for level in range(levels, -1, -1):
        sides = []
        for nodes, name in ((a, "a"), (b, "b")):
            nodes = nodes.where(F.col("level") == level).select("file", "node", F.col("digest").alias(name))
            sides.append(nodes if wrong is None else nodes.withColumn("up", F.expr(f"node div {FAN}")).join(wrong.withColumnRenamed("node", "up"), ["file", "up"], "left_semi").drop("up"))
        wrong = sides[0].join(sides[1], ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "node")
    wrong = stash(wrong, "wrong-ranges")
    sides = []
    for replica, name in ((ours, "a"), (theirs, "b")):
        suspect = replica.withColumn("node", F.expr(f"offset div {RANGE}")).join(wrong, ["file", "node"], "left_semi")
        sides.append(suspect.groupBy("file", "offset", F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")).agg(F.first("page_id").alias(f"page_{name}"), F.min("digest").alias(name)))
    found = sides[0].join(sides[1], ["file", "offset", "key"], "full").where(~F.col("a").eqNullSafe(F.col("b")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return found.select("file", "offset", F.coalesce("page_a", "page_b").alias("page_id"), status.alias("status"))


def fixity(pages: DataFrame, replica_body: Column, replica_present: Column) -> DataFrame:
    """Every record of pages with its place, its digest and what the audit of a replica says of it.

    The replica's records are built and hashed from replica_body where replica_present holds; its places come from
    the archive's manifest. Null url or html is empty; a null page_id is written as nothing and stands first in its file;
    equal rows are records of their own, at places of their own; an empty table gives no rows.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    ours, theirs = (record(F.col("page_id"), F.col("url"), b) for b in (body, F.encode(F.coalesce(replica_body, F.lit("")), "UTF-8")))
    hashed = pages.select("page_id", F.octet_length(ours).cast("long").alias("length"), F.sha2(ours, 256).alias("digest"), F.when(replica_present, F.sha2(theirs, 256)).alias("replica"))
    placed = stash(layout(stash(hashed, "digests")), "manifest")
    found = audit(placed.select("file", "offset", "page_id", "digest"), placed.where(F.col("replica").isNotNull()).select("file", "offset", "page_id", F.col("replica").alias("digest")))
    joined = placed.join(found.select("file", "offset", "status"), ["file", "offset"], "left")
    return joined.select("page_id", "file", "offset", "length", F.col("digest").alias("sha256"), F.coalesce("status", F.lit("intact")).alias("status"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with known faults: by the page's MD5, one in 256 records
    is changed by a byte at its end, and one in 256 is missing."""
    fault = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    return fixity(table(spark, sf_dir, "pages"), F.when(fault == "00", F.concat("html", F.lit("!"))).otherwise(F.col("html")), fault != "01")


# ---------------------------------------------------------------- files

_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)")
_FIELD = re.compile(rb"(?im)^(warc-record-id|warc-target-uri):[ \t]*(.*?)\r?$")
_GZIP = b"\x1f\x8b\x08"


def _writer(folder: str, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, None, 0
        try:
            for batch in batches:
                starts, sizes = [], []
                for file, data in zip(batch.column("file").to_pylist(), batch.column("data"), strict=True):
                    if file != name:  # records come in the order of their files
                        if out:
                            out.close()
                            os.replace(f"{path}.{os.getpid()}", path)
                        name, at, path = file, 0, f"{folder}/{file:06d}.warc.gz"
                        out = open(f"{path}.{os.getpid()}", "wb")  # noqa: SIM115  a task that is run again writes the same file
                    member = gzip.compress(data.as_py(), 6, mtime=0)
                    out.write(member)
                    starts.append(at)
                    sizes.append(len(member))
                    at += len(member)
                columns = [batch.column("file"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), batch.column("page_id").cast(kind), batch.column("digest")]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "size", "page_id", "digest"])
        finally:
            if out:
                out.close()
                if sys.exc_info()[0] is None:
                    os.replace(f"{path}.{os.getpid()}", path)

    return write


def write_files(pages: DataFrame, folder: str, min_files: int = MIN_FILES) -> DataFrame:
    """Write all pages as WARC files, a gzip member a record, and return their manifest (file, offset, size, page_id, digest).

    folder is a path that all executors share. Files hold about FILE_BYTES bytes of records before compression and are written by a
    task each; a file appears under its name when it is whole, so a task that is lost is simply run again. offset and size are
    those of the member. Null url or html is empty. An empty table writes nothing.
    """
    data = record(F.col("page_id"), F.col("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    rows = pages.select("page_id", data.alias("data"))
    placed = layout(rows.select("page_id", F.octet_length("data").cast("long").alias("length"), F.sha2("data", 256).alias("digest"), "data"), min_files)
    os.makedirs(folder, exist_ok=True)
    dealt = placed.select("file", "offset", "page_id", "digest", "data").repartition("file").sortWithinPartitions("file", "offset")
    kind = pages.schema["page_id"].dataType
    fields = f"file int, offset long, size long, page_id {kind.simpleString()}, digest string"
    return stash(dealt.mapInArrow(_writer(folder, to_arrow_type(kind)), fields), "manifest")


def members(stream: BinaryIO) -> Iterator[tuple[int, bytes | None]]:
    """(offset, data) of the gzip members of a file, read in pieces; data is None where a member is damaged, and the
    search goes on at the next member's first bytes."""
    held, at, ended = b"", 0, False

    def more() -> bool:
        nonlocal held, ended
        piece = stream.read(1 << 20)
        held, ended = held + piece, not piece
        return not ended

    while held or more():
        out, unpack, used = [], zlib.decompressobj(31), 0
        try:
            while not unpack.eof:
                if used == len(held) and not more():
                    raise zlib.error("cut off")
                out.append(unpack.decompress(held[used:]))
                used = len(held) - len(unpack.unused_data)
        except zlib.error:
            yield at, None
            while (found := held.find(_GZIP, 1)) < 0 and more():
                pass
            used = found if found > 0 else len(held)
        else:
            yield at, b"".join(out)
        held, at = held[used:], at + used


def parse(data: bytes) -> tuple[str, str, bytes]:
    """(record id, address, body) of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.decode() for k, v in _FIELD.findall(head)}
    length = _LENGTH.search(head)
    return fields.get(b"warc-record-id", ""), fields.get(b"warc-target-uri", ""), rest[: int(length[1])] if length else rest


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows: list[tuple] = []
            size = 0
            file = int(os.path.basename(path).split(".")[0])
            with open(path.removeprefix("file:"), "rb") as stream:
                for offset, data in members(stream):
                    found = (None, None, None, None) if data is None else (*parse(data), hashlib.sha256(data).hexdigest())
                    rows.append((file, offset, found[0], found[1], found[2], found[3]))
                    size += len(data or b"")
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "offset", "record_id", "url", "body", "digest"])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, record_id, url, body, digest) of every member of the WARC files in a folder that all executors share.

    A file is read in pieces by one task. Of a damaged member only file and offset are known.
    """
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    n = max(1, paths.count())
    return paths.repartition(n).mapInArrow(_reader, "file int, offset long, record_id string, url string, body binary, digest string")


def audit_files(manifest: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """What the files of a replica have against the manifest of write_files; a damaged member's page is missing, and what
    stands in its place is extra, without an id."""
    page = F.regexp_extract("record_id", "<urn:page:(.*)>", 1)
    found = read_files(spark, folder).select("file", "offset", F.when(page != "", page).cast(manifest.schema["page_id"].dataType).alias("page_id"), F.coalesce("digest", F.lit("damaged")).alias("digest"))
    return audit(manifest.select("file", "offset", "page_id", "digest"), stash(found, "replica"))


def _sql(text: str) -> str:
    return "'" + text.replace("\r\n", "' || chr(13) || chr(10) || '") + "'"


OP6_SQL = f"""
WITH records AS (
  SELECT page_id, encode({_sql(HEADER[0])} || page_id::VARCHAR || {_sql(HEADER[1])} || url || {_sql(HEADER[2])}
         || octet_length(encode(html))::VARCHAR || {_sql(HEADER[3])} || html || {_sql(END)}) AS rec FROM pages),
hashed AS (SELECT page_id, (('0x' || substr(sha256(rec), 1, 8))::BIGINT % {MIN_FILES})::INTEGER AS file, octet_length(rec)::BIGINT AS length, sha256(rec) AS sha256 FROM records)
SELECT page_id, file, coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
       length, sha256, CASE substr(md5(page_id::VARCHAR), 1, 2) WHEN '00' THEN 'changed' WHEN '01' THEN 'missing' ELSE 'intact' END AS status
FROM hashed
"""
