import hashlib

import duckdb
from pyspark.sql import functions as F

from quern.llm.warc import HEADER, OP6_SQL, RANGE, audit, audit_files, fixity, layout, op6_merkle_fixity, read_files, record, tree, write_files

from .helpers import rows_of

PAGES = "page_id long, url string, html string"


def replica(rows):
    return [(f, o, p, hashlib.sha256(d.encode()).hexdigest()) for f, o, p, d in rows]


def test_audit_finds_what_differs_and_nothing_else(spark):
    rows = [(f, i * 700, i, f"{f}-{i}") for f in range(3) for i in range(400)]
    bad = [r for r in rows if r[:2] not in {(1, 700 * 17), (2, 0)}]
    bad = [(f, o, p, d + "!") if (f, p) in {(0, 399), (1, 200), (1, 201)} else (f, o, p, d) for f, o, p, d in bad] + [(2, 700 * 400, 400, "new"), (5, 0, 0, "file")]
    schema = "file int, offset long, page_id long, digest string"
    ours, theirs = (spark.createDataFrame(replica(x), schema).repartition(3) for x in (rows, bad))
    want = [(0, 700 * 399, 399, "changed"), (1, 700 * 17, 17, "missing"), (1, 700 * 200, 200, "changed"), (1, 700 * 201, 201, "changed"), (2, 0, 0, "missing"), (2, 700 * 400, 400, "extra"), (5, 0, 0, "extra")]
    assert rows_of(audit(ours, theirs), "file", "offset", "page_id", "status") == sorted(want, key=repr)
    assert audit(ours, ours).count() == 0
    assert audit(ours.limit(0), ours.limit(0)).count() == 0


def test_tree_equals_hashes_by_hand(spark):
    rows = replica([(0, 0, 1, "a"), (0, RANGE - 1, 2, "b"), (0, RANGE, 3, "c")])
    nodes = {(r.level, r.node): r.digest for r in tree(spark.createDataFrame(rows, "file int, offset long, page_id long, digest string"), 1).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    low = [sha(rows[0][3] + rows[1][3]), sha(rows[2][3])]
    assert nodes == {(0, 0): low[0], (0, 1): low[1], (1, 0): sha("".join(low))}


def test_awkward_pages(spark):
    rows = [(1, "http://é/", "<p>ü"), (2, None, None), (None, "u", "x"), (3, "u", ""), (3, "u", ""), (4, "v", "z" * 300_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("offset", F.lit(1)).withColumn("digest", F.lit("x"))
    got = fixity(pages, F.when(F.col("page_id") == 4, F.concat("html", F.lit(" "))).otherwise(F.col("html")), F.coalesce(F.col("page_id") != 1, F.lit(True)))
    want = []
    for page, url, html in rows:
        body = (html or "").encode()
        data = (HEADER[0] + ("" if page is None else str(page)) + HEADER[1] + (url or "") + HEADER[2] + str(len(body)) + HEADER[3]).encode() + body + b"\r\n\r\n"
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), {1: "missing", 4: "changed"}.get(page, "intact")))
    assert rows_of(got, "page_id", "length", "sha256", "status") == sorted(want, key=repr)
    assert fixity(pages.limit(0), F.col("html"), F.lit(True)).count() == 0


def test_records_lie_one_after_another(spark):
    sizes = spark.createDataFrame([(i, f"{i:03d}", 10 + i) for i in range(300)], "page_id long, digest string, length long")
    for file in range(4):
        rows = sorted((r.offset, r.length) for r in layout(sizes, 4).where(F.col("file") == file).collect())
        assert [o for o, _ in rows] == [sum(n for _, n in rows[:i]) for i in range(len(rows))]


def test_records_parse_back(spark):
    data = spark.createDataFrame([(7, "http://a/", "<p>ü\r\n\r\nWARC/1.0")], PAGES).select(record(F.col("page_id"), F.col("url"), F.encode("html", "UTF-8")).alias("r")).first().r
    head, _, rest = bytes(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    assert rest[: int(fields["Content-Length"])].decode() == "<p>ü\r\n\r\nWARC/1.0" and rest[int(fields["Content-Length"]) :] == b"\r\n\r\n"


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    names = ("page_id", "file", "offset", "length", "sha256", "status")
    want = con.execute(f'SELECT page_id, file, "offset", length, sha256, status FROM ({OP6_SQL})').fetchall()
    assert rows_of(op6_merkle_fixity(spark, sf), *names) == sorted(want, key=repr)
    assert {w[5] for w in want} == {"intact", "changed", "missing"}


def test_files_round_trip_and_damage_is_found(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(300).unionByName(spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", "\r\n\r\nWARC/1.0\r\n")], PAGES))
    manifest = write_files(pages.repartition(3), f"{tmp_path}/a", 5)
    back = read_files(spark, f"{tmp_path}/a").select(F.regexp_extract("record_id", "([0-9]+)", 1).cast("long").alias("page_id"), "url", F.decode("body", "UTF-8").alias("html"))
    assert rows_of(back, "page_id", "url", "html") == rows_of(pages.fillna("", ["url", "html"]), "page_id", "url", "html")
    assert audit_files(manifest, spark, f"{tmp_path}/a").count() == 0 and write_files(pages.limit(0), f"{tmp_path}/b").count() == 0
    rows = sorted(manifest.collect(), key=lambda r: (r.file, r.offset))
    path = tmp_path / "a" / f"{rows[0].file:06d}.warc.gz"
    data = bytearray(path.read_bytes())
    hit = [r for r in rows if r.file == rows[0].file]
    data[hit[3].offset + hit[3].size // 2] ^= 0xFF  # a flipped byte in one member
    del data[hit[-1].offset :]  # and the last one lost
    path.write_bytes(bytes(data))
    found = rows_of(audit_files(manifest, spark, f"{tmp_path}/a"), "offset", "page_id", "status")
    assert found == sorted([(hit[3].offset, hit[3].page_id, "missing"), (hit[3].offset, None, "extra"), (hit[-1].offset, hit[-1].page_id, "missing")], key=repr)


def test_a_page_that_was_captured_very_often(spark):
    sizes = spark.range(3000).select(F.when(F.col("id") < 1000, 64).otherwise(F.col("id") * 64).alias("page_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.lit(100).cast("long").alias("length"))
    counts = [r["count"] for r in layout(sizes).groupBy("file").count().collect()]
    assert len(counts) == 64 and max(counts) < 100
    equal = spark.range(2000).select(F.lit(1).alias("page_id"), F.lit("ab").alias("digest"), F.lit(100).cast("long").alias("length"))
    assert sorted(r.offset for r in layout(equal).collect()) == [100 * i for i in range(2000)]
