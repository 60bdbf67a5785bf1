"""Line dedup against levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import BLANKS, LOWER, PLACE, UPPER, attach, drop_stash, located, may_hold, neutral, own_folder, stash, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Documents of a batch, and the fewest batches that a table is dealt into.
BATCH_DOCS, MIN_BATCHES = 1 << 30, 4
#: Runs of a level that merge into one of the next.
FAN_IN = 2
#: Rows whose ids tell where batches begin, if ids have no percentiles.
CUT_SAMPLE = 10_000
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    """128 bits: two 64-bit hashes with independent seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5DEECE66D), key).alias("h2")]


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper) in levels; FAN_IN runs of a level merge into one of the next.

    Batches come in descending order of doc_id, so that the keeper of a key, the largest doc_id
    with it, is known from the first batch that has the key. n_docs counts the documents of a batch and of all before it.
    Once it reaches min_docs the key is settled: further ones change nothing, and the anti-join keeps them out of
    later runs. What is stored is a row for each distinct key of a batch at most.

    A run is a table of the shared folder, dealt into as many buckets as the session has shuffle partitions, and each
    bucket is one sorted file. Merges, and the anti-join of a batch that is dealt the same way, so read the runs
    in order, bucket by bucket: they shuffle and sort nothing but the batch.
    """

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fan_in: int = FAN_IN) -> None:
        self.spark, self.min_docs, self.fan_in = spark, min_docs, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    @contextmanager
    def _in_order(self) -> Iterator[None]:
        """Plans made inside know that a bucket of one file is sorted."""
        name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(name)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def _runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def settled(self) -> DataFrame:
        """(h1, h2, keeper) of the keys of at least min_docs documents; the runs are deleted. A key is settled in one run."""
        try:
            found = [self.spark.table(run).where(F.col("n_docs") >= self.min_docs).select(*HASH, "keeper") for run in self._runs()]
            return stash(reduce(DataFrame.unionByName, found), "settled-lines")
        finally:
            self.drop()

    def drop(self) -> None:
        """Delete all runs, those of a failed write too."""
        self._drop(self._runs())
        self.levels = []

    def add(self, keys: DataFrame) -> None:
        """keys: (doc_id, h1, h2), a row for each document and distinct key."""
        own = keys.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).withColumn("before", F.lit(0).cast("long"))
        with self._in_order():
            # an anti-join that also tells what is counted so far; Catalyst would push a plain one below the grouping of hot keys
            for run in map(self.spark.table, self._runs()):
                known = run.toDF(*HASH, "n2", "keeper2").hint("merge")
                own = own.join(known, list(HASH), "left").where(F.coalesce("n2", F.lit(0)) < self.min_docs)
                own = own.select(*HASH, "n_docs", F.greatest("keeper", "keeper2").alias("keeper"), F.greatest("before", "n2").alias("before"))
            self._put(0, own.select(*HASH, (F.col("n_docs") + F.col("before")).alias("n_docs"), "keeper"))

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted runs as one: the larger count is that of the later batch, which includes the other's."""
        both = a.join(b.toDF(*HASH, "n2", "keeper2").hint("merge"), list(HASH), "full")
        return both.select(*HASH, F.greatest("n_docs", "n2").alias("n_docs"), F.greatest("keeper", "keeper2").alias("keeper"))

    def _put(self, level: int, rows: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        name = f"quern_line_run_{uuid.uuid4().hex}"
        self.levels[level].append(name)
        rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{own_folder(self.spark)}/{name}").saveAsTable(name)
        if len(self.levels[level]) == self.fan_in:
            runs = self.levels[level]
            self._put(level + 1, reduce(self._merge, map(self.spark.table, runs)))
            self.levels[level] = []
            self._drop(runs)

    def _drop(self, runs: Sequence[str]) -> None:
        for run in runs:
            if self.spark.catalog.tableExists(run):
                files = self.spark.table(run)
                drop_stash(files)
                self.spark.sql(f"DROP TABLE {run}")


def _cuts(docs: DataFrame, batches: int | None) -> list:
    """Ids at which batches begin, the highest first. Where they lie only decides how even batches are."""
    if batches is None:
        batches = max(MIN_BATCHES, -(-docs.count() // BATCH_DOCS))
    shares = [i / batches for i in range(1, batches)]
    if not shares:
        return []
    if isinstance(docs.schema["doc_id"].dataType, T.NumericType):
        found = docs.select(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []
    else:  # other ids that have an order: cuts between a few drawn at random
        ids = sorted(r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.rand(7)).limit(CUT_SAMPLE).collect())
        found = [ids[int(s * len(ids))] for s in shares] if ids else []
    return sorted(set(found), reverse=True)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int | None = None) -> DataFrame:
    """(doc_id, *PLACE, pos, h1, h2, first, batch) of every line with a key of min_chars characters, written by batch.

    first marks the first line of each key in its document. Text is read once for all batches.
    """
    cuts = _cuts(docs, batches)
    batch = sum((F.coalesce(F.col("doc_id") < F.lit(c), F.lit(True)).cast("int") for c in cuts), F.lit(0))
    keyed = F.transform(_lines(F.col("text")), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("pos")))
    keyed = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    found = docs.select("doc_id", *PLACE, batch.alias("batch"), F.sort_array(F.transform(keyed, lambda x: F.struct(*_hashes(x["key"]), x["pos"].alias("pos")))).alias("lines"))
    same = lambda x, y: F.coalesce((x["h1"] == y["h1"]) & (x["h2"] == y["h2"]), F.lit(False))
    marked = F.transform("lines", lambda x, i: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), x["pos"].alias("pos"), (~same(x, F.get("lines", i - 1))).alias("first")))
    return stash(found.select("doc_id", *PLACE, "batch", F.explode(marked).alias("x")).select("doc_id", *PLACE, "x.*", "batch"), "line-hashes", by=["batch"])


def build_runs(lines: DataFrame, min_docs: int = MIN_DOCS) -> LineRuns:
    """Feed the lines to LineRuns batch by batch, the highest ids first."""
    runs = LineRuns(lines.sparkSession, min_docs)
    try:
        for batch in sorted(r[0] for r in lines.select("batch").distinct().collect()):
            runs.add(lines.where((F.col("batch") == batch) & F.col("first")).select("doc_id", *HASH))
    except BaseException:
        runs.drop()
        raise
    return runs


def dropped_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int | None) -> DataFrame:
    """(*PLACE, positions) of the lines to drop, a row for each document that loses any."""
    lines = hashed_lines(docs, min_chars, batches)
    runs = build_runs(lines, min_docs)
    if not runs.levels:
        return lines.groupBy(*PLACE).agg(F.collect_set("pos").alias("positions"))
    # written, so that both sides of the join are plain exchanges, whose hot keys Spark can split
    settled = runs.settled()
    suspect = may_hold(lines, settled, HASH).where("__may").select("doc_id", *PLACE, "pos", *HASH)
    hit = suspect.join(settled.select(*HASH, "keeper").hint("merge"), list(HASH)).where(F.col("keeper").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = stash(hit.groupBy(*PLACE).agg(F.collect_set("pos").alias("positions")), "dropped-lines")
    drop_stash(lines)
    drop_stash(settled)
    return drops


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """Drop repeated lines: documents as they are, with text replaced and n_lines and n_dropped added.

    A key of at least min_chars code points that at least min_docs documents hold loses all its
    lines but those in the largest doc_id that holds it. One scan hashes the lines, the runs give the settled keys, and
    the lines that have one are merge-joined with them. The positions to drop go back to their documents by file and row;
    only documents that lose lines, and few others, are shuffled for that.

    Null or empty text is one empty line, and comes out empty. Rows that share a doc_id count as
    documents of their own, and all of them keep the key if theirs is the largest id. A null doc_id
    is below every other; where only null ids hold a key, its lines stay. Repeats of a key within the keeper stay. An
    empty table gives no rows. Ids are of any type that has an order. Columns named n_lines or n_dropped are replaced;
    others pass through.
    """
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    docs = located(neutral(docs, "doc_id", "text"))
    kept = attach(docs, dropped_lines(docs, min_chars, min_docs, batches).withColumnRenamed("positions", "__drop"))
    kept = kept.withColumn("__lines", _lines(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - F.lit(1)), F.col("__drop"))
    text = F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n")
    columns = [F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(text).alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in PLACE]
    n_dropped = F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size("__drop"))
    return kept.select(*columns, F.size("__lines").cast("long"), n_dropped.cast("long")).toDF(*names, "n_lines", "n_dropped")


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Rows are documents of their own, whatever ids they share, as in dedup_lines.
OP2_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT rid) >= {MIN_DOCS}),
marked AS (
  SELECT k.*, c.keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""
