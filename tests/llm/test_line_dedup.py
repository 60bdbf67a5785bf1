import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from quern.llm._common import located
from quern.llm.line_dedup import OP2_SQL, LineRuns, build_runs, dedup_lines, hashed_lines, op2_line_runs

from .helpers import ROBOTS, awkward, awkward_rows, empty, rows_of

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, min_chars=20, min_docs=3):
    """The rule word by word; each row is a document."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
    holders, keeper = defaultdict(set), {}
    for n, (doc, text) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].add(n)
                if doc is not None:
                    keeper[k] = max(doc, keeper.get(k, doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or keeper.get(key(x)) is None or doc == keeper[key(x)]]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    want = brute([(r[0], r[1]) for r in awkward_rows()])
    for batches in (1, 4):
        got = dedup_lines(awkward(spark), batches=batches)
        assert rows_of(got, "doc_id", "text", "n_lines", "n_dropped") == want
    assert [c for c in awkward(spark).columns if c != "n_dropped"] + ["n_lines", "n_dropped"] == got.columns
    assert any(n for *_, n in want) and ROBOTS in next(t for d, t, *_ in want if d == 105)


def test_empty_table(spark):
    assert dedup_lines(empty(spark)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP2_SQL})").fetchall())
    assert rows_of(op2_line_runs(spark, sf_dir), "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)
    assert all(len(r[3]) == 64 for r in want) and hashlib.sha256(b"").hexdigest() not in {""}


def test_repeated_ids_equal_sql(spark):
    line = "a line that rows of one id share among them"
    rows = [(1, line), (1, line), (2, line), (None, line), (3, "other\n" + line.upper()), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP2_SQL})").fetchall()
    got = dedup_lines(docs).withColumn("kept_sha256", F.sha2(F.col("text").cast("binary"), 256))
    assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == sorted(want, key=repr)


def test_ids_of_any_type(spark):
    line = "the same line again and again"
    docs = spark.createDataFrame([(f"id-{i}", f"{line}\n{i}") for i in range(20)] + [(None, line)], "doc_id string, text string")
    for batches in (1, 4):
        kept = dedup_lines(docs, batches=batches).where(F.col("text").contains(line))
        assert rows_of(kept, "doc_id") == [("id-9",)]


def test_settled_keys_stay_out_of_later_runs(spark):
    docs = spark.createDataFrame([(i, "a line that every document has in it") for i in range(40)], "doc_id long, text string")
    runs = build_runs(hashed_lines(located(docs), batches=4))
    rows = [r for level in runs.levels for run in level for r in spark.table(run).collect()]
    assert len(rows) == 1 and rows[0].n_docs < 40  # the first batch settles the key
    assert runs.settled().select("keeper").first()[0] == 39


def test_levels_compact_and_merge_without_a_shuffle(spark):
    runs = LineRuns(spark, fan_in=2)
    for i in range(4):
        runs.add(spark.createDataFrame([(10 - i, i, i), (10 - i, 99, 99)], "doc_id long, h1 long, h2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    run = runs.levels[2][0]
    assert sorted(tuple(r) for r in spark.table(run).collect()) == [(0, 0, 1, 10), (1, 1, 1, 9), (2, 2, 1, 8), (3, 3, 1, 7), (99, 99, 3, 10)]
    with runs._in_order():
        plan = runs._merge(spark.table(run), spark.table(run))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert rows_of(runs.settled(), "h1", "keeper") == [(99, 10)]
