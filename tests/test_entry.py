import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return connection


def plain(value):
    """Numbers by value alone: the two engines name their integer types differently."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    return float(value)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


CORE = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, con, sf_dir, name):
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    want = con.execute(entry.oracle_sql()[name])
    assert sorted(d[0] for d in want.description) == columns
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    as_rows = lambda rows: sorted(tuple(plain(v) for v in r) for r in rows)
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    got_rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=key)
    want_rows = sorted((tuple(plain(v) for v in r) for r in want), key=key)
    assert len(got_rows) == len(want_rows)
    for a, b in zip(got_rows, want_rows, strict=True):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(v, float) for v in a) else a == b


REST = sorted(n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", REST)
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    for path in ROOT.glob("quern/**/*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    """A partition's border is no border of the domain: stencils, runs and pairs are the same at any partition count."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in (1, 4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append({name: sorted(map(tuple, entry.queries()[name](spark, sf_dir).collect())) for name in ("laplace_filter", "heat_steps", "run_length_sum", "cell_range_join", "batch_split", "ring_shift")})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
