import itertools
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.llm.filter_audit import OP12_SQL, RULES, audit_filters, failure_cells, op12_filter_audit

from .helpers import SCHEMA, awkward, awkward_rows, empty, rows_of

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int"


def fails(text, copy):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    upper = len(re.findall("[A-Z]", text))
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * upper > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}


def brute(docs, labels):
    least = {}
    for d, t, *_ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    parts = defaultdict(list)
    for d, t, _, source, _ in docs:
        parts[source or ""].append((d, fails(t or "", d is not None and d > least[t or ""])))
    out = []
    for part, rows in parts.items():
        shapley, found = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for i, x in enumerate(order):
                left = [(d, f) for d, f in rows if not any(f[y] for y in order[:i])]
                here = [d for d, f in left if f[x]]
                shapley[x] += len(here)
                unique = sum(f[x] and sum(f.values()) == 1 for _, f in rows)
                found.append((x, part, "".join(order), i + 1, len(left) - len(here), len(here), sum(f[x] for _, f in rows) - len(here), unique, sum(d in good for d in here), sum(d in toxic for d in here)))
        out += [(*r[1:], shapley[r[0]]) for r in found]
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    docs = awkward_rows()
    docs += [(400 + i, docs[3][1], "en", f"s{i % 2}", 1) for i in range(50)] + [(500, "A" * 50 + " b#" * 300, None, "s0", 1), (None, docs[3][1], "en", "s1", 1)]
    docs += [(600 + i, " ".join(f"w{j}{i}" for j in range(250)) + " $" * (i % 2), "en", "s1", 1) for i in range(9)]
    labels = [(3, 1, 0), (3, 0, 1), (400, 1, 1), (401, None, 1), (None, 1, 1), (201, 1, None), (9999, 1, 1), (601, 1, 0), (602, 0, 1)]
    frame = spark.createDataFrame(docs, SCHEMA).select("*", *[F.lit(7).alias(c) for c in ("part", "mask", "digest", "n", "good", "__words", "step")]).repartition(5)
    held = spark.createDataFrame(labels, LABELS).withColumn("n", F.lit(1)).withColumn("part", F.lit("x"))
    assert rows_of(audit_filters(frame, held), *COLUMNS) == brute(docs, labels)
    assert audit_filters(empty(spark), held).count() == 0
    assert rows_of(audit_filters(awkward(spark), held.limit(0)), *COLUMNS) == brute(awkward_rows(), [])


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    ours = rows_of(op12_filter_audit(spark, sf_dir), *COLUMNS)
    assert ours == brute(docs, labels)
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP12_SQL})").fetchall(), key=repr) == ours


def test_copies_of_one_text_are_counted_not_gathered(spark):
    """A text that nine of ten rows hold comes to the window over texts as a few counts."""
    rows = [(i, "the same text" if i % 10 else f"text {i}", "en", f"s{i % 2}", 1) for i in range(2000)]
    cells = failure_cells(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], LABELS))
    assert {(r.part, r["mask"]): r.n for r in cells.collect()} == {("s0", 1): 200, ("s1", 1): 1, ("s0", 17): 800, ("s1", 17): 999}


@pytest.mark.parametrize("letters", ["A", "AD"])
def test_fewer_rules(spark, sf_dir, letters):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = audit_filters(docs, labels, {x: RULES[x] for x in letters}).where("part = 'src0'").collect()
    n = docs.where("source = 'src0'").count()
    assert len(found) == {1: 4, 2: 18}[len(letters)]
    by_order = defaultdict(list)
    for r in found:
        by_order[r.filter_order].append(r)
    assert all(sum(r.removed for r in rs) + min(r.kept for r in rs) == n for rs in by_order.values())
