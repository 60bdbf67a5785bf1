"""What each filter of a chain removes, in every order of the chain, from counts of failure masks alone."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BLANKS, table

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: What a filter is told of a text: all columns, none null.
Facts = Mapping[str, Column]
RULES: dict[str, Callable[[Facts], Column]] = {
    "A": lambda f: f["n_words"] < MIN_WORDS,
    "B": lambda f: 100 * f["n_distinct"] < MIN_DISTINCT_PERCENT * f["n_words"],
    "C": lambda f: 100 * f["n_upper"] > MAX_UPPER_PERCENT * f["n_points"],
    "D": lambda f: f["text"].rlike(SYMBOLS),
}
#: The filter that a text fails which a smaller doc_id has too.
COPY = "E"


def _facts(text: str) -> dict[str, Column]:
    words = F.col("__words")
    return {
        "text": F.col(text),
        "n_words": F.size(words).cast("long"),
        "n_distinct": F.size(F.array_distinct(words)).cast("long"),
        "n_upper": F.regexp_count(F.col(text), F.lit("[A-Z]")).cast("long"),
        "n_points": F.char_length(text).cast("long"),
    }


def failing_rows(docs: DataFrame, rules: Mapping[str, Callable[[Facts], Column]] = RULES) -> DataFrame:
    """doc_id, part, digest (SHA-256 of the text) and mask (bit i: the i-th rule fails) of each document."""
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    trimmed = F.btrim("text", F.lit(BLANKS))
    rows = rows.withColumn("__words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    facts, mask = _facts("text"), F.lit(0)
    for i, rule in enumerate(rules.values()):
        mask = mask + F.when(rule(facts), 1 << i).otherwise(0)
    return rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask.alias("mask"))


def failure_cells(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Callable[[Facts], Column]] = RULES) -> DataFrame:
    """part, mask, n, good, toxic: how many documents of a part fail exactly the filters of mask, and how many of them
    are labelled. The bit after those of the rules is COPY's.

    Equal texts fail the same rules, so rows are counted by text, part, mask and labels before their least doc_id is
    sought: however many copies a text has, a part holds four counts of it at most.
    """
    ids = failing_rows(docs, rules).groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    named = ids.join(marks, "doc_id", "left").select(*ids.columns, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    known = F.col("doc_id").isNotNull()
    texts = named.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("nameless")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("originals", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    held = F.array(F.struct(F.lit(0).alias("copy"), F.col("originals").alias("n")), F.struct(F.lit(1 << len(rules)).alias("copy"), (F.col("n") - F.col("originals")).alias("n")))
    cells = texts.select("part", "mask", "good", "toxic", F.explode(held).alias("h")).where("h.n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("h.n")).otherwise(0))
    return cells.groupBy("part", (F.col("mask") + F.col("h.copy")).alias("mask")).agg(F.sum("h.n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def _orders(letters: str) -> list[dict]:
    """A step of every order: bits of the filters before it, and its own."""
    return [
        {"filter_order": "".join(order), "step": i + 1, "before": sum(1 << letters.index(x) for x in order[:i]), "own": 1 << letters.index(order[i])}
        for order in itertools.permutations(letters)
        for i in range(len(letters))
    ]


def audit_cells(cells: DataFrame, letters: str) -> DataFrame:
    """Every order and step of each part, from its cells: part, mask, n, good, toxic (2^k rows a part at most)."""
    steps = F.from_json(F.lit(json.dumps(_orders(letters))), "array<struct<filter_order string, step int, before int, own int>>")
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).select("part", "cells", F.explode(steps).alias("s"))
    before, own = F.col("s.before"), F.col("s.own")
    fails = lambda c, bits: c["mask"].bitwiseAND(bits) != 0

    def total(chosen: Callable[[Column], Column], what: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.when(chosen(c), what(c)).otherwise(F.lit(0)).cast("long"))

    here = lambda c: fails(c, own) & ~fails(c, before)
    n = lambda c: c["n"]
    # of the filters that a text fails, each is the first of them in equally many orders
    turns = lambda c: c["n"] * (F.lit(math.factorial(len(letters))) / F.bit_count(c["mask"])).cast("long")
    return parts.select(
        "part",
        "s.filter_order",
        "s.step",
        total(lambda c: ~fails(c, before) & ~fails(c, own), n).alias("kept"),
        total(here, n).alias("removed"),
        total(lambda c: fails(c, own) & fails(c, before), n).alias("redundant"),
        total(lambda c: c["mask"] == own, n).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: fails(c, own), turns).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Callable[[Facts], Column]] = RULES) -> DataFrame:
    """A row for each part (the source), order of the filters and step: what is kept, removed and lost there.

    rules: native expressions by letter, each true where a text fails; COPY comes after them. filter_order is applied
    left to right and step (from 1) is the filter at that place. kept: left after it. removed: failing it and none
    before. redundant: failing it and one before. unique_fails: failing no other. good_lost, toxic_lost: removed here and
    labelled quality or toxic = 1. shapley: its removed documents summed over all orders. Counts are long.
    All texts are read once; rows of an id, a part, a digest and a mask are shuffled, never texts; each part's cells
    alone are spread over the orders.
    Null text: empty. Null source: part ''. A row without doc_id has no smaller id beside it and is no original for
    others, so COPY keeps it. Rows that share doc_id and text are all kept or all removed by COPY. Of an id's labels one
    that says 1 is enough; labels without document are passed over. Empty table: no rows. Other columns don't matter.
    """
    letters = "".join(rules) + COPY
    return audit_cells(failure_cells(docs, labels, rules), letters)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Each document is sent through each step of each order; no cells.
OP12_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM docs),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failing AS (SELECT s.doc_id, part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(s.doc_id > min(s.doc_id) OVER (PARTITION BY text), false)] AS fails FROM split s LEFT JOIN marks m ON s.doc_id = m.doc_id),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda i: chr(64 + i)), '') AS filter_order, step::INT AS step, o[step] AS own FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (SELECT part, good, toxic, filter_order, step, own, fails[own] AS now, list_bool_or(list_prepend(false, list_transform(o[1:step - 1], lambda i: fails[i]))) AS gone, list_sum(list_transform(fails, lambda f: f::INT)) AS n_fails FROM failing, steps),
counts AS (SELECT part, filter_order, step, own, count(*) FILTER (NOT now AND NOT gone) AS kept, count(*) FILTER (now AND NOT gone) AS removed, count(*) FILTER (now AND gone) AS redundant,
    count(*) FILTER (now AND n_fails = 1) AS unique_fails, count(*) FILTER (now AND NOT gone AND good = 1) AS good_lost, count(*) FILTER (now AND NOT gone AND toxic = 1) AS toxic_lost FROM told GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts
"""
