"""Token counts of whole texts, by batches that hold about equally many bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import byte_blocks, table
from .encoding import encoder

LIMIT = 512
#: Bytes of text that are handed to the tokenizer at once.
BLOCK_BYTES = 1 << 20


def _counter(path: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for block in byte_blocks(batches, "text", BLOCK_BYTES):
            texts = block.column("text")
            n_tokens = pa.array(tokens.lengths(texts.to_pylist()), pa.int64())
            n_bytes = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), n_bytes, n_tokens, pc.greater(n_tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return count


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each document.

    vocabulary is the path of a tokenizer file: .json (tokenizers), .model (sentencepiece) or .tiktoken.
    Only lengths leave the Arrow function. It works on blocks of about BLOCK_BYTES bytes; long texts of
    byte-level files are cut where no token can reach over, so a very long text is as cheap a byte as
    a short one and its ids are never held whole. One pass over the input splits, which Spark sizes by bytes; no shuffle.
    Null or empty text: no bytes, no tokens. Equal rows are counted alike; an empty table gives no rows;
    null ids pass through; other columns don't matter.
    """
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(_counter(vocabulary, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
