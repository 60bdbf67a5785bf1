"""The corpus pipeline: five stages, each one of the corpus operators on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm._common import drop_stash, settle, table
from quern.llm.decontam import drop_contaminated
from quern.llm.line_dedup import dedup_lines
from quern.llm.packing import TEMPERATURE, pack
from quern.llm.quality import filter_quality
from quern.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside the compression bands go."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one of them; n_chars follows the text."""
    kept = dedup_lines(docs)
    return kept.select(*[F.char_length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least doc_id."""
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows contaminate go; the others stay as they are."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens; small sources come oftener than their size says."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), temperature=TEMPERATURE)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixture packing", mixture_packing),
]

#: zstandard, SimHash components and tokens are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each one's rows are written to the shared folder for the next.

    What a stage needed on its way is deleted when its rows are written, and they are when the next stage's are.
    Nulls, empty and very long texts, repeated rows and ids pass through as each stage says; an empty table gives no
    rows; other columns of the documents pass through all stages but the last, which has its own.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        after = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            drop_stash(docs)
        docs = after
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_stash(docs)
    return packed
