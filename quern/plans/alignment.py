"""Local alignment of reads with windows of a reference sequence (survey M02, V02, T08)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels.alignment import align
from ..operators.kernels.paths import path

RESULT = "read string, score int, query_end int, target_end int"
#: Cells of the matrices that one vector step goes over.
CELLS = 1 << 16


def _batches(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    start, width = 0, 0
    for i, n in enumerate(rows["target"].str.len()):
        if i > start and max(width, n) * (i - start + 1) > CELLS:
            yield rows.iloc[start:i]
            start, width = i, 0
        width = max(width, n)
    if start < len(rows):
        yield rows.iloc[start:]


def align_pairs(pairs: DataFrame) -> DataFrame:
    """RESULT for (read, query, target, start): ends count in the query and, from `start`, in the reference."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.fillna({"query": "", "target": ""}).sort_values("target", key=lambda s: s.str.len(), kind="stable")
            for rows in _batches(part):
                score, i, j = align([x.encode() for x in rows["query"]], [x.encode() for x in rows["target"]])
                yield pd.DataFrame({"read": rows["read"].to_numpy(), "score": score, "query_end": i, "target_end": rows["start"].to_numpy() + j})

    return pairs.select("read", "query", "target", "start").mapInPandas(run, RESULT)


#: Words in a row that a query and a target share, if they are aligned at all.
SEED_WORDS = 8


def seeds(texts: DataFrame, key: str, text: str, words: int = SEED_WORDS) -> DataFrame:
    """(key, seed): the hashes of all runs of so many words of each text."""
    held = texts.select(key, F.split(F.trim(text), r"\s+").alias("w")).where(F.size("w") >= words)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.xxhash64(F.slice("w", i, words)))
    return held.select(key, F.explode(F.array_distinct(runs)).alias("seed"))


def align_seeded(queries: DataFrame, targets: DataFrame, words: int = SEED_WORDS, paths: bool = False) -> DataFrame:
    """(query_id, target_id, score, query_end, target_end) of the queries (query_id, query) and targets (target_id, target) that share a seed.
    With paths also (query_start, target_start, steps): where the alignment begins, and its run lengths of =, X, I and D.

    All targets are read; only those that share a run of words with a query are aligned, so there is a row for each such pair.
    """
    found = seeds(queries, "query_id", "query", words).join(seeds(targets, "target_id", "target", words), "seed").select("query_id", "target_id").distinct()
    pairs = found.join(queries, "query_id").join(targets, "target_id")
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in ("query_id", "target_id"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part = part.sort_values("target", key=lambda s: s.str.len(), kind="stable")
            for rows in _batches(part):
                score, i, j = align([x.encode() for x in rows["query"]], [x.encode() for x in rows["target"]])
                found = pd.DataFrame({"query_id": rows["query_id"].to_numpy(), "target_id": rows["target_id"].to_numpy(), "score": score, "query_end": i, "target_end": j})
                if paths:
                    ways = [path(q.encode(), t.encode(), int(a), int(b)) for q, t, a, b in zip(rows["query"], rows["target"], i, j, strict=True)]
                    found[["query_start", "target_start", "steps"]] = pd.DataFrame(ways, columns=["query_start", "target_start", "steps"])
                yield found

    more = ", query_start int, target_start int, steps string" if paths else ""
    return pairs.select("query_id", "target_id", "query", "target").mapInPandas(run, f"{kinds}, score int, query_end int, target_end int{more}")


def align_reads(reads: DataFrame, windows: DataFrame, reference: DataFrame) -> DataFrame:
    """reads (name, seq), windows (name, start, stop), one reference sequence (seq), which is broadcast as it is one row."""
    joined = reads.join(windows, "name").crossJoin(F.broadcast(reference.select(F.col("seq").alias("whole"))))
    target = F.expr("substring(whole, start + 1, stop - start)")
    return align_pairs(joined.select(F.col("name").alias("read"), F.col("seq").alias("query"), target.alias("target"), "start"))


def plausibility(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of reads whose target end lies within ten of the truth, and the correlation of scores with mutations."""
    joined = found.join(truth, "read")
    near = F.abs(F.col("target_end") - (F.col("true_origin") + F.col("query_end"))) <= 10
    return joined.agg(F.avg(near.cast("double")).alias("near"), F.corr("score", F.col("n_subs") + F.col("n_indels")).alias("correlation"), F.sum("score").alias("checksum"))
