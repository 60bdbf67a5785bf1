"""Small tables with every awkward case, and rows as plain tuples."""

from __future__ import annotations

import random

#: Columns that documents don't have, named like columns that operators use or return.
CLASHES = "n_words long, kept boolean, size long, queue int, part int, fp long, h1 long, key string, items string, n_dropped long, spans string, c0 string, __text string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROBOTS = "this page was made by a robot and it says the same thing each time"


def awkward_rows(seed: int = 0) -> list[tuple]:
    """Nulls in any column, empty and very long texts, repeated rows and ids, ties, copies, shared lines."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "Über", "naïve", "delta", "日本", "x1", "e", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 80)) + "\n" + text(rng.randint(1, 12)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100 + i, f"{ROBOTS}\n{text(30)}\n  {ROBOTS.upper()}\t", "en", "s0", None) for i in range(6)]
    rows += [(200, None, None, None, None), (201, "", "", "", 0), (202, "\n\n", "de", None, 2), (None, text(40), "en", "s1", 1), (None, None, None, None, None)]
    rows += [(203, text(20000), "en", "s2", 1), (204, "y" * 30000, "en", "s2", 1), (205, " \t ", "en", "s2", 3)]
    rows += [rows[3], rows[3], (3, "another text under the same id", "en", "s1", 1), (300, rows[5][1], "en", "s0", 1), (301, rows[5][1], "en", "s0", 1)]
    return rows


def awkward(spark, clash: bool = True, seed: int = 0):
    df = spark.createDataFrame(awkward_rows(seed), SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CLASHES.split(", ")])
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
