"""Two tokenizers of the same texts laid side by side: groups, links and the links' counts in the whole corpus."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import byte_blocks, stash, table
from .encoding import Encoder, encoder

#: Bytes of text whose owners are held as arrays at once.
BLOCK_BYTES = 1 << 20
#: Bytes of text whose id pairs have numbers of their own.
CHUNK_BYTES = 1 << 23
#: Id pairs in a row of a chunk's list.
SLICE = 4096


class Bytes:
    """The bytes that each id of an encoder stands for."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], np.int64)


@functools.cache
def _sides(first: str, second: str) -> tuple[Encoder, Bytes, Encoder, Bytes]:
    a, b = encoder(first), encoder(second)
    return a, Bytes(a.token_bytes()), b, Bytes(b.token_bytes())


@functools.cache
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of each number below most with a place for one more character, and how many they are."""
    width = len(str(most)) + 1
    text = [str(i).encode().ljust(width) for i in range(most)]
    return np.frombuffer(b"".join(text), np.uint8).reshape(most, width), np.array([len(str(i)) for i in range(most)], np.int64)


def _pieces(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of a document in parts of about BLOCK_BYTES bytes, cut only where tokens of both sides end."""
    if ends_a[-1] <= BLOCK_BYTES:
        yield a, b
        return
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    start = i = j = 0
    while start < ends_a[-1]:
        end = cuts[max(np.searchsorted(cuts, start + BLOCK_BYTES, "right") - 1, np.searchsorted(cuts, start, "right"))]
        i2, j2 = np.searchsorted(ends_a, end, "right"), np.searchsorted(ends_b, end, "right")
        yield a[i:i2], b[j:j2]
        start, i, j = end, i2, j2


class Digest:
    """A SHA-256 of what it is given, but for the last character."""

    def __init__(self) -> None:
        self.hash, self.last = hashlib.sha256(), b""

    def update(self, text: bytes) -> None:
        self.hash.update(self.last + text[:-1])
        self.last = text[-1:]

    def hexdigest(self) -> str:
        return self.hash.hexdigest()


class Chunk:
    """Documents whose id pairs are numbered together."""

    def __init__(self, first: str, second: str) -> None:
        self.a, self.bytes_a, self.b, self.bytes_b = _sides(first, second)
        self.digits, self.n_digits = _digits(max(len(self.bytes_a.tokens), len(self.bytes_b.tokens)))
        self.stats: list[list] = []  # n_a, n_b, n_groups, n_links of each document
        self.hashes: list[Digest | None] = []
        self.size = 0
        self.waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.waiting_bytes = 0
        #: a block's distinct pairs; for its documents in turn their numbers among these and how often
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, text: str | None) -> None:
        doc, want = len(self.stats), b" " + text.encode() if text else b""
        self.stats.append([0, 0, 0, 0])
        self.hashes.append(None)
        self.size += len(want)
        if not text:
            return
        a, b = self.a.plain_ids(" " + text), self.b.plain_ids(text)
        if b"".join(map(self.bytes_a.tokens.__getitem__, a.tolist())) != want or b"".join(map(self.bytes_b.tokens.__getitem__, b.tolist())) != want:
            return
        self.stats[doc][:2] = len(a), len(b)
        self.hashes[doc] = Digest()
        for part in _pieces(a, np.cumsum(self.bytes_a.size[a]), b, np.cumsum(self.bytes_b.size[b])):
            n = int(self.bytes_a.size[part[0]].sum())
            if self.waiting_bytes + n > BLOCK_BYTES:
                self.flush()
            self.waiting.append((doc, *part))
            self.waiting_bytes += n

    def flush(self) -> None:
        """Align the parts that wait, as one array of bytes; a part's end is a cut, so no group or link reaches over."""
        if not self.waiting:
            return
        docs = np.array([w[0] for w in self.waiting])
        a, b = np.concatenate([w[1] for w in self.waiting]).astype(np.int64), np.concatenate([w[2] for w in self.waiting]).astype(np.int64)
        part_a, part_b = (np.repeat(np.arange(len(docs)), [len(w[k]) for w in self.waiting]) for k in (1, 2))
        self.waiting, self.waiting_bytes = [], 0
        owner_a = np.repeat(np.arange(len(a), dtype=np.int32), self.bytes_a.size[a])
        owner_b = np.repeat(np.arange(len(b), dtype=np.int32), self.bytes_b.size[b])
        new_a, new_b = np.diff(owner_a) != 0, np.diff(owner_b) != 0
        starts = np.concatenate(([0], np.flatnonzero(new_a | new_b) + 1))
        link_a, link_b = owner_a[starts], owner_b[starts]
        group = np.concatenate(([0], np.cumsum(new_a & new_b, dtype=np.int32)))
        group_a, group_b = (group[np.cumsum(size[ids]) - size[ids]] for size, ids in ((self.bytes_a.size, a), (self.bytes_b.size, b)))
        del owner_a, owner_b, new_a, new_b, group
        self._hash(docs, a, b, part_a, part_b, group_a, group_b)

        part = part_a[link_a]
        for k, counts in ((2, np.bincount(part_a[np.diff(group_a, prepend=-1) != 0], minlength=len(docs))), (3, np.bincount(part, minlength=len(docs)))):
            for doc, n in zip(docs.tolist(), counts.tolist(), strict=True):
                self.stats[doc][k] += n
        pairs, number = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
        mine, times = np.unique(docs[part] * len(pairs) + number, return_counts=True)
        self.blocks.append((pairs, *(x.astype(np.int32) for x in (mine // len(pairs), mine % len(pairs), times))))

    def _hash(self, docs: np.ndarray, a: np.ndarray, b: np.ndarray, part_a: np.ndarray, part_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> None:
        """The groups as text: ids of a group with commas, | between the sides and ; between groups."""
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        at_a, at_b = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a], np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids, after, parts = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8), np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b], parts[at_a], parts[at_b] = a, b, part_a, part_b
        after[at_a[np.diff(group_a, append=-1) != 0]] = ord("|")
        after[at_b[np.diff(group_b, append=-1) != 0]] = ord(";")
        text, n = self.digits[ids], self.n_digits[ids]
        text[np.arange(len(ids)), n] = after
        flat = text[np.arange(text.shape[1]) <= n[:, None]].tobytes()
        ends = np.cumsum(np.bincount(parts, n + 1, len(docs))).astype(np.int64)
        for doc, start, end in zip(docs.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            self.hashes[doc].update(flat[start:end])

    def rows(self) -> tuple[list[list], list[bytes], np.ndarray, np.ndarray]:
        """The statistics and packed links of each document; the chunk's pairs, and in how many of its documents each is."""
        self.flush()
        pairs = np.unique(np.concatenate([x[0] for x in self.blocks])) if self.blocks else np.empty(0, np.int64)
        doc, number, times = (np.concatenate(x) if self.blocks else np.empty(0, np.int64) for x in ([x[1] for x in self.blocks], [np.searchsorted(pairs, x[0]).astype(np.int32)[x[2]] for x in self.blocks], [x[3] for x in self.blocks]))
        # a document that came in several parts has a pair once for each of them
        key, of = np.unique(doc.astype(np.int64) * max(1, len(pairs)) + number, return_inverse=True)
        times = np.bincount(of, times, len(key)).astype(np.int64)
        doc, number = key // max(1, len(pairs)), key % max(1, len(pairs))
        held = np.bincount(number, minlength=len(pairs))
        borders = np.searchsorted(doc, np.arange(len(self.stats) + 1))
        return self.stats, [pack(number[s:e], times[s:e]) for s, e in zip(borders[:-1], borders[1:], strict=True)], pairs, held


def pack(number: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending numbers and counts as differences, in byte planes, compressed."""
    both = np.concatenate((np.diff(number, prepend=0), times)).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8)
    both = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _aligner(first: str, second: str, kind: pa.DataType, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batches_of(chunk: Chunk, number: int, ids: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        stats, links, pairs, held = chunk.rows()
        n, starts = len(stats), range(0, len(pairs), SLICE)
        none = lambda k, t: pa.nulls(k, t)
        columns = np.array(stats, np.int64).reshape(n, 4).T
        hashes = pa.array([h.hexdigest() if h else "" for h in chunk.hashes], pa.string())
        for start in range(0, n, SLICE):
            of = slice(start, start + SLICE)
            k = min(SLICE, n - start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["docs"] * k), pa.array([number] * k, pa.int64()), pa.concat_arrays(ids)[of], *[pa.array(c[of]) for c in columns], hashes[of], pa.array(links[of], pa.binary())]
                + [none(k, t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))],
                names=names,
            )
        k = len(starts)
        if k:
            lists = [pa.array([x[s : s + SLICE] for s in starts], pa.list_(pa.int64())) for x in (pairs, held)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["pairs"] * k), pa.array([number] * k, pa.int64()), none(k, kind), *[none(k, pa.int64())] * 4, none(k, pa.string()), none(k, pa.binary()), pa.array(list(starts), pa.int64()), *lists],
                names=names,
            )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunk, ids = TaskContext.get().partitionId() << 32, Chunk(first, second), []
        for batch in batches:
            for block in byte_blocks([batch], "text", BLOCK_BYTES):
                for text in block.column("text").to_pylist():
                    chunk.add(text)
                ids.append(block.column("doc_id"))
                if chunk.size >= CHUNK_BYTES:
                    yield from batches_of(chunk, number, ids)
                    number, chunk, ids = number + 1, Chunk(first, second), []
        if ids:
            yield from batches_of(chunk, number, ids)

    return align


def _count_links(key: tuple, docs: pa.Table, counts: pa.Table) -> pa.Table:
    number = counts.column("number").to_numpy()
    n, best = (np.zeros(len(number), np.int64) for _ in range(2))
    n[number], best[number] = counts.column("n").to_numpy(), counts.column("best").to_numpy()
    sums, bests = [], []
    for packed in docs.column("links").to_pylist():
        of, times = unpack(packed)
        sums.append(int(n[of] @ times))
        bests.append(int(best[of] @ times))
    return docs.drop_columns(["chunk", "links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align_tokens(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of each document.

    first, second: paths of tokenizer files. The first gets a space before the text, the second is one that adds it
    itself; special strings are plain text to both. Where tokens of both end, the text is cut into groups; groups_sha256
    is of their ids as `a1,a2|b1;a3|b2,b3`. A link is a pair of tokens, one of each side, whose bytes overlap; a pair of
    ids counts the documents that hold it linked. count_sum adds these counts over a document's links, n_best counts the
    links whose pair has the highest count of all pairs with its first id.

    Texts are read and encoded once. A task numbers the id pairs of each chunk of about 8 MB, so what meets in the
    corpus-wide count is a row for each pair of a chunk, however often its documents hold it, and what comes back to a
    chunk are its own pairs' counts: nothing broadcast grows with the data, a group holds one chunk. Blocks of 1 MB hold
    the owners of bytes; longer texts are aligned in parts, cut where both sides end a token.
    Null or empty text, and one whose bytes either side doesn't give back: zeros and ''. Repeated rows each count as a
    document. Null ids pass through; an empty table gives no rows; other columns don't matter.
    """
    held = docs.select("doc_id", "text")
    kind = held.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, chunk long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, start long, pairs array<long>, held array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_type

    rows = stash(held.mapInArrow(_aligner(first, second, to_arrow_type(held.schema["doc_id"].dataType), names), schema), "token-links", "zstd", by=["kind"])
    pairs = rows.where("kind = 'pairs'").select("chunk", "start", F.posexplode(F.arrays_zip("pairs", "held"))).select("chunk", (F.col("start") + F.col("pos")).alias("number"), F.col("col.pairs").alias("pair"), F.col("col.held").alias("held"))
    totals = pairs.groupBy("pair").agg(F.sum("held").alias("n"))
    # an id of the first side has as many rows here as the second side has ids, at most
    totals = totals.withColumn("best", (F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32)))).cast("long"))
    counts = pairs.select(F.col("chunk").alias("of"), "number", "pair").join(totals, "pair").select("of", "number", "n", "best")
    texts = rows.where("kind = 'docs'").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(_count_links, out)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
