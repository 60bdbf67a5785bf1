"""Quality rules: word and line statistics, and bands of zstandard ratios by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import neutral, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Texts of at least min_bytes bytes must compress to a share within [low, high] of their size."""

    min_bytes: int
    low: float
    high: float


#: Whole documents and chunks. Short texts hardly compress, long ones do; what falls below low repeats itself, what lies above
#: high is noise. high is set by length between the most that clean texts of sf0.1 reach (and, under 192 bytes, their
#: runs of twenty words) and the least of random base64 words: 0.98 and 1.00 at 100 bytes, 0.75 and 0.86 at 300,
#: 0.59 and 0.76 at 1,200, 0.48 and 0.74 at 6,000.
WHOLE_BANDS = (
    Band(0, 0.40, 0.99),
    Band(112, 0.40, 0.967),
    Band(128, 0.35, 0.945),
    Band(160, 0.35, 0.93),
    Band(192, 0.35, 0.875),
    Band(256, 0.25, 0.80),
    Band(384, 0.25, 0.765),
    Band(512, 0.25, 0.74),
    Band(768, 0.25, 0.71),
    Band(1024, 0.20, 0.68),
    Band(1536, 0.20, 0.65),
    Band(2048, 0.20, 0.63),
    Band(3072, 0.20, 0.62),
    Band(4096, 0.18, 0.60),
    Band(8192, 0.18, 0.59),
    Band(16384, 0.15, 0.58),
)
#: Chunks of CHUNK bytes, of texts of that size or more; the rest is a chunk too, or if it has fewer than LEAST_REST
#: bytes, the end of the last one. Each chunk is judged by the band of its length, so every byte is.
CHUNK, LEAST_REST = 4096, 256
#: A text is rejected if its bad chunks hold this share of its bytes, or, however long it is, this many bytes.
BAD_SHARE, BAD_BYTES = 0.25, 2 * CHUNK
LEVEL = 3

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "zstd_ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that the text holds twice or more, first ones included.

    Equal windows get equal numbers by doubling: words, pairs, fours, eights. Exact, no hashes.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    level = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    for step in (1, 2, 4):
        pairs = level[:-step] * (int(level.max()) + 1) + level[step:]
        _, level, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(level):
            return 0
    twice = np.flatnonzero(counts[level] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, twice, 1)
    np.add.at(edges, twice + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def _within(size: int, ratio: float) -> bool:
    band = max((b for b in WHOLE_BANDS if size >= b.min_bytes), key=lambda b: b.min_bytes)
    return band.low <= ratio <= band.high


def chunks(text: bytes) -> list[bytes]:
    """The text in pieces of CHUNK bytes and its rest; none if it is shorter than one."""
    ends = [*range(CHUNK, len(text) + 1, CHUNK)]
    if ends and len(text) - ends[-1] >= LEAST_REST:
        ends.append(len(text))
    return [text[a:b] for a, b in zip([0, *ends], [*ends[:-1], len(text)], strict=False)] if ends else []


def measure(text: bytes, zstd: zstandard.ZstdCompressor) -> tuple:
    """A row of SCHEMA for one text; zstd compresses without a frame header's size or checksum mattering."""
    words = text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum() - counts[9:14].sum() - counts[32])
    symbols = int(counts[list(SYMBOLS)].sum())
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
    ratio = len(zstd.compress(text)) / len(text) if text else 1.0
    pieces = chunks(text)
    bad = [len(c) for c in pieces if not _within(len(c), len(zstd.compress(c)) / len(c))]
    fits = _within(len(text), ratio) and not (bad and (sum(bad) >= BAD_SHARE * len(text) or sum(bad) >= BAD_BYTES))
    return len(words), chars, symbols, dup_lines(text), repeated, failed, ratio, len(pieces), len(bad), fits and not failed


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        rows = [measure(t.as_py() or b"", zstd) for t in texts]
        columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
        if rows:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *_NAMES])


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def score(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in keep and those of SCHEMA, a row for each document; one pass, no shuffle.

    Null text counts as empty: no words, hence base_failed. Whole texts are read, of whatever length.
    Equal rows are judged alike; an empty table gives no rows; null ids pass through.
    """
    held = docs.select(*keep, F.coalesce("text", F.lit("")).alias("__text"))
    fields = ", ".join([*(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keep), SCHEMA])
    return held.mapInArrow(_judge, fields)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that keep the rules, with their own columns only: judged where they are read, without a join."""
    plain = neutral(docs, "text")
    judged = score(plain.withColumn("body", F.col("text")), tuple("body" if c == "text" else c for c in plain.columns))
    return judged.where("kept").select(*["body" if c == "text" else c for c in plain.columns]).toDF(*docs.columns)


def op9_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
