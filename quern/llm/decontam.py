"""Benchmark decontamination: an FM-index per shard of training text, searched for all test windows at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from ._common import PLACE, attach, located, neutral, stash, table
from .fm_index import FMIndex

WINDOW = 13
#: A document is contaminated if its hit words are this share of its words at least: 1 / SHARE.
SHARE = 20
#: Words of documents behind one index.
SHARD_WORDS = 1 << 20
#: Occurrences that are located at once.
LOCATE_ROWS = 1 << 20
#: Bytes of benchmark text whose windows are broadcast and searched together; more text is searched in blocks.
BLOCK_BYTES = 4 << 20

#: Lower-cases A-Z and blanks the ASCII characters that are not word characters; lengths stay.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A document's new columns; items are of the type of item_id.
FIELDS = "n_words long, n_hit long, items array<{}>, spans array<struct<start:long,end:long>>, contaminated boolean"
#: The same words for Spark, upper case or lower.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass
class Windows:
    """The test windows of some items. Words are numbered from 1; a document word that no item has is 0."""

    number: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    #: items of pattern p: the names[i] of item_ids[item_at[p]:item_at[p + 1]]; names are in order
    item_at: np.ndarray
    item_ids: np.ndarray
    names: list


def windows_of(items: Sequence[tuple[Any, bytes]]) -> Windows:
    number: dict[bytes, int] = {}
    holders: dict[tuple[int, ...], set[int]] = {}
    names = sorted({item for item, _ in items if item is not None})
    place = {item: i for i, item in enumerate(names)}
    for item, text in items:
        ids = [number.setdefault(w, len(number) + 1) for w in words_of(text)]
        for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            holders.setdefault(tuple(ids[at : at + WINDOW]), set()).update(() if item is None else (place[item],))
    patterns = np.zeros((len(holders), WINDOW), np.int64)
    for row, window in zip(patterns, holders, strict=True):
        row[: len(window)] = window
    lists = [sorted(x) for x in holders.values()]
    item_at = np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))).astype(np.int64)
    return Windows(number, patterns, np.array([len(w) for w in holders], np.int64), item_at, np.array([i for x in lists for i in x], np.int64), names)


class Shard:
    """The documents behind one index, as numbers of benchmark words.

    The index's alphabet is that of the tests: other words are separators, runs of them are one, and runs of
    test words shorter than the shortest window are left out, since no window can occur in them.
    """

    def __init__(self, tests: Windows) -> None:
        self.tests = tests
        self.docs: list[np.ndarray] = []
        self.words = 0

    def add(self, text: bytes) -> None:
        of = self.tests.number.get
        words = words_of(text)
        self.docs.append(np.fromiter((of(w, 0) for w in words), np.int32, len(words)))
        self.words += len(words)

    def hits(self) -> Iterator[tuple[int, np.ndarray, list]]:
        """For each document, in order: its words, which of them are hit, and the items with occurring windows."""
        sizes = np.array([len(d) for d in self.docs], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))  # a separator after each document
        stream = np.zeros(int(starts[-1]), np.int64)
        for at, doc in zip(starts.tolist(), self.docs, strict=False):
            stream[at : at + len(doc)] = doc
        covered = np.zeros(len(stream) + 1, np.int64)
        found: list[np.ndarray] = []
        if len(self.tests.lengths):
            text, origin = _dense(stream, int(self.tests.lengths.min()))
            index = FMIndex(text, len(self.tests.number) + 1)
            low, high = index.search(self.tests.patterns, self.tests.lengths)
            for a, b in _interval_blocks(low, high):
                pattern, place = index.locate(a, b)
                at = origin[place]
                covered += np.bincount(at, minlength=len(covered)) - np.bincount(at + self.tests.lengths[pattern], minlength=len(covered))
                doc = np.searchsorted(starts, at, "right") - 1
                found.append(np.unique(doc * len(low) + pattern))
        hit = np.cumsum(covered) > 0
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        doc, pattern = np.divmod(pairs, max(1, len(self.tests.lengths)))
        edges = np.searchsorted(doc, np.arange(len(self.docs) + 1))
        for i, size in enumerate(sizes.tolist()):
            item_at = self.tests.item_at
            items = {int(x) for p in pattern[edges[i] : edges[i + 1]].tolist() for x in self.tests.item_ids[item_at[p] : item_at[p + 1]]}
            yield size, hit[starts[i] : starts[i] + size], [self.tests.names[x] for x in sorted(items)]


def _dense(stream: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least `shortest` test words, a separator after each, and where each symbol stood."""
    known = np.concatenate(([0], (stream > 0).astype(np.int8), [0]))
    change = np.diff(known)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    long = end - begin >= shortest
    begin, sizes = begin[long], (end - begin)[long] + 1
    origin = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    text = np.append(stream, 0)[origin]
    return text, origin


def _interval_blocks(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The intervals in blocks of LOCATE_ROWS rows at most; empty where they have no part in a block."""
    total = np.concatenate(([0], np.cumsum(np.maximum(high - low, 0))))
    for at in range(0, int(total[-1]), LOCATE_ROWS):
        a = low + np.clip(at - total[:-1], 0, None)
        b = np.minimum(high, low + np.clip(at + LOCATE_ROWS - total[:-1], 0, None))
        yield a, np.maximum(a, b)


def merged_spans(hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words, as half-open spans of word numbers."""
    change = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return [{"start": a, "end": b} for a, b in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist(), strict=True)]


def cut(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The text without the spans' words and what stands between them."""
    if not spans:
        return text
    places = [m.span() for m in re.finditer(rb"[^ \t\n\x0b\x0c\r]+", text.translate(_WORDS))]
    kept, at = [], 0
    for span in spans:
        kept.append(text[at : places[span["start"]][0]])
        at = places[span["end"] - 1][1]
    return b"".join([*kept, text[at:]])


def _scanner(tests: Broadcast, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(shard: Shard, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        n_words, n_hit, items, spans = [], [], [], []
        for size, hit, found in shard.hits():
            n_words.append(size)
            n_hit.append(int(np.count_nonzero(hit)))
            items.append(found)
            spans.append(merged_spans(hit))
        kept = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        bad = [h > 0 and SHARE * h >= n for n, h in zip(n_words, n_hit, strict=True)]
        new = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(kind)), pa.array(spans, _SPANS), pa.array(bad)]
        return pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*kept.schema.names, "n_words", "n_hit", "items", "spans", "contaminated"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(tests.value), []
        for batch in batches:
            texts = batch.column("__text").cast(pa.binary())
            rest = batch.drop_columns(["__text"])
            start = 0
            for i, text in enumerate(texts):
                shard.add(text.as_py())
                if shard.words >= SHARD_WORDS:
                    yield rows(shard, [*held, rest.slice(start, i + 1 - start)])
                    shard, held, start = Shard(tests.value), [], i + 1
            if start < batch.num_rows:
                held.append(rest.slice(start))
        if held:
            yield rows(shard, held)

    return scan


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[Any, bytes]]]:
    """The items in blocks of about BLOCK_BYTES bytes: what is collected and broadcast at once is bounded."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.select(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    for block in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield [(r["item_id"], r["text"].encode()) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and those of FIELDS, a row for each document.

    A window is WINDOW consecutive words of an item, or a whole item of fewer words. items holds the ids of the
    items with occurring windows, spans the merged runs of hit words. Each task indexes its documents in shards
    of about SHARD_WORDS words, a document whole in one shard; nothing is shuffled while the benchmark fits one
    block. A larger one is searched block by block, one broadcast at a time; the hits are written, and merged and
    attached by file and row, so that no text is shuffled but that of documents with hits.

    Null or empty text has no words and isn't contaminated. A null item_id contaminates, but isn't listed. Items
    that share an id count as one; ids are of any type that has an order. Equal documents get equal rows; empty tables work.
    """
    spark = docs.sparkSession
    named = benchmark.schema["item_id"].dataType
    found = FIELDS.format(named.simpleString())
    held = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    blocks = _benchmark_blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        fields = [f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keep]
        return held.mapInArrow(_scanner(spark.sparkContext.broadcast(windows_of(first)), to_arrow_type(named)), ", ".join([*fields, found]))
    held = located(held)
    parts = []
    for items in chain((first, second), blocks):
        tests = spark.sparkContext.broadcast(windows_of(items))
        hits = held.select(*PLACE, "__text").mapInArrow(_scanner(tests, to_arrow_type(named)), f"{PLACE[0]} long, {PLACE[1]} long, {found}")
        parts.append(stash(hits.where("n_hit > 0").select(*PLACE, "items", "spans"), "benchmark-hits"))
        tests.destroy()
    merged = reduce(DataFrame.unionByName, parts).groupBy(*PLACE)
    merged = merged.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = stash(merged.select(*PLACE, "__items", F.expr(_MERGE).alias("__spans")), "merged-hits")
    n_hit = F.expr("aggregate(__spans, 0L, (n, s) -> n + s.end - s.start)")
    n_words = F.regexp_count("__text", F.lit(_WORD)).cast("long")
    new = attach(held, merged).select(*keep, n_words.alias("n_words"), F.coalesce(n_hit, F.lit(0).cast("long")).alias("n_hit"), "__items", "__spans")
    bad = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    none = lambda c: F.coalesce(c, F.array().cast(merged.schema[c].dataType))
    return new.select(*keep, "n_words", "n_hit", none("__items").alias("items"), none("__spans").alias("spans"), bad.alias("contaminated"))


#: Spans in order, each merged with the last one before it if they meet.
_MERGE = """aggregate(spans, cast(array() as array<struct<start:bigint,end:bigint>>), (done, s) ->
  if(size(done) > 0 and element_at(done, -1).end >= s.start,
     concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
     concat(done, array(s))))"""


def _judged(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, list[str]]:
    """All columns of docs under neutral names, those of FIELDS, and the neutral names in order; the text is body."""
    plain = neutral(docs, "text")
    names = ["body" if c == "text" else c for c in plain.columns]
    return scan(plain.withColumn("body", F.col("text")), benchmark, tuple(names)), names


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, as they are, judged where they are read."""
    judged, names = _judged(docs, benchmark)
    return judged.where(~F.col("contaminated")).select(*names).toDF(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All documents, with the merged spans of test words cut out of text."""
    judged, names = _judged(docs, benchmark)

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("body")
            texts, spans = batch.column(at).to_pylist(), batch.column("spans").to_pylist()
            cleaned = [cut(t.encode(), s).decode() if s else t for t, s in zip(texts, spans, strict=True)]
            yield batch.set_column(at, "body", pa.array(cleaned, pa.string())).drop_columns(["spans"])

    fields = ", ".join(f"{c} {judged.schema[c].dataType.simpleString()}" for c in names)
    return judged.select(*names, "spans").mapInArrow(cutter, fields).toDF(*docs.columns)


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")
