import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quern.llm import decontam
from quern.llm.decontam import cut_spans, drop_contaminated, op10_fm_decontamination, scan
from quern.llm.fm_index import FMIndex, suffix_array

from .helpers import awkward, awkward_rows, empty, rows_of


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    sizes = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (held := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= held - {None}
        yield doc, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=80), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=5), min_size=1, max_size=6), st.integers(1, 5))
def test_index_finds_every_occurrence(text, patterns, sample):
    index = FMIndex(np.array(text, np.int64), 4, sample)
    table, lengths = np.zeros((len(patterns), 5), np.int64), np.array([len(p) for p in patterns])
    for row, p in zip(table, patterns, strict=True):
        row[: len(p)] = p
    got = sorted(zip(*(x.tolist() for x in index.locate(*index.search(table, lengths))), strict=True))
    assert got == sorted((k, i) for k, p in enumerate(patterns) for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p)


def test_suffix_array_of_repeats():
    for text in ([1] * 50, [1, 2] * 40, [3, 1, 2, 1, 2, 1], [5], []):
        assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


ITEMS = [(1, " ".join(f"q{i}" for i in range(30))), (2, "short Item, five words here"), (2, "more of item two"), (None, "nobody knows this item at all"), (4, None), (5, "..."), (6, "short item five words here")]


def planted(spark):
    one, two = ITEMS[0][1], "SHORT item; five words HERE"
    rows = [(900, f"before {one} after", "en", "s", 1), (901, " ".join(f"q{i}" for i in range(12)), "en", "s", 1), (902, two, None, "s", 1), (903, "filler " * 400 + two, "en", "s", 1), (904, "nobody-knows-this-item-at-all!", "en", "s", 1)]
    return awkward_rows() + rows


def test_planted_and_awkward_rows(spark, monkeypatch):
    rows = planted(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(brute([(r[0], r[1]) for r in rows], ITEMS), key=repr)
    shape = lambda df: sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in df.collect()), key=repr)
    assert shape(scan(docs, items)) == want
    monkeypatch.setattr(decontam, "SHARD_WORDS", 50)
    monkeypatch.setattr(decontam, "LOCATE_ROWS", 3)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)  # several blocks
    assert shape(scan(docs, items)) == want
    assert {w[0] for w in want if w[4]} >= {900, 902, 904} and not {901, 903} & {w[0] for w in want if w[4]}


def test_string_ids_and_blocks(spark, monkeypatch):
    docs = awkward(spark).union(awkward(spark).limit(0)).withColumn("text", F.when(F.col("doc_id") == 5, F.lit("x " + ITEMS[0][1] + " y")).otherwise(F.col("text")))
    items = spark.createDataFrame([(f"set-{i % 2}{i}" if i is not None else None, t) for i, t in ITEMS], "item_id string, text string")
    for _ in range(2):
        found = scan(docs, items).where("n_hit > 0").collect()
        assert [r.doc_id for r in found] == [5] and found[0]["items"] == [f"set-{ITEMS[0][0] % 2}{ITEMS[0][0]}"] and found[0].contaminated == (20 * found[0].n_hit >= found[0].n_words)
        assert rows_of(drop_contaminated(docs, items), *docs.columns) == rows_of(docs.where("doc_id is null or doc_id <> 5"), *docs.columns)
        monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    assert scan(empty(spark), items).count() == 0


def test_removal(spark):
    rows = [(1, f"Keep this, {ITEMS[0][1].upper()}! and that."), (2, None), (3, "clean Über text"), (4, "short item five words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert rows_of(cut_spans(docs, items), "doc_id", "text") == sorted([(1, "Keep this, ! and that."), (2, None), (3, "clean Über text"), (4, "")], key=repr)
    assert {r.doc_id for r in drop_contaminated(docs, items).collect()} == {2, 3}
    clash = awkward(spark)
    assert drop_contaminated(clash, items).columns == clash.columns
    assert scan(docs, items.limit(0)).where("n_hit > 0").count() == 0 and scan(empty(spark), items).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    digest = lambda items: hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
    want = [(d, n, h, len(i), digest(i), c) for d, n, h, i, c in brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))]
    assert rows_of(op10_fm_decontamination(spark, sf_dir), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert any(w[5] for w in want)


def test_sql_equals_brute_force(spark, sf_dir):
    import duckdb

    from quern.llm.decontam_sql import OP10_SQL

    con = duckdb.connect()
    docs = spark.createDataFrame(planted(spark), "doc_id long, text string, lang string, source string, n_chars long").where("doc_id is not null and length(text) < 15000").dropDuplicates(["doc_id"])
    items = [i for i in ITEMS if i[0] is not None]
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    got = sorted(con.execute(f"SELECT doc_id, n_words, n_hit, n_items, contaminated FROM ({OP10_SQL})").fetchall())
    assert got == sorted((d, n, h, len(i), c) for d, n, h, i, c in brute(rows, items)) and any(r[4] for r in got)
