"""What the corpus operators share: the cluster's shared folder, intermediate tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.checkpoints import shared_folder

#: The only characters that the corpus contracts treat as white space.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that stash() wrote since the settle() that runs in this thread began; none if none runs.
_run: ContextVar[list[str] | None] = ContextVar("run", default=None)


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/quern/{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str, codec: str = "snappy", by: Sequence[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and a lost executor costs nothing. by: folders by value."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _run.get()) is not None:
        made.append(path)
    df.write.option("compression", codec).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stash(df: DataFrame) -> None:
    """Delete the files of tables that stash() wrote and nothing needs any more."""
    spark = df.sparkSession
    mark = f"/quern/{spark.sparkContext.applicationId}/"
    for folder in {f[: f.index("/", f.index(mark) + len(mark))] for f in df.inputFiles() if mark in f}:
        _delete(spark, folder)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stash what make() returns, and delete all tables that it stashed on the way to it, also if it fails.

    They are told by a list of this run, so what other threads, sessions and applications write in the meantime stays.
    """
    made: list[str] = []
    token = _run.set(made)
    kept = None
    try:
        rows = make()
        done, kept = stash(rows, name), made[-1]
    finally:
        _run.reset(token)
        spark = SparkSession.active()
        for folder in made:
            if folder != kept:
                _delete(spark, folder)
    if (outer := _run.get()) is not None:
        outer.append(kept)
    return done


def clear_stash(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; results that still read them must be written first."""
    _delete(spark, own_folder(spark))


def neutral(docs: DataFrame, *keep: str) -> DataFrame:
    """The table with its columns renamed c0, c1, ... but for those in keep, so that no name can clash with an operator's own."""
    return docs.toDF(*[n if n in keep else f"c{i}" for i, n in enumerate(docs.columns)])


def byte_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about limit bytes, one row at least; no row is copied."""
    for batch in batches:
        sizes = batch.column(column)
        start = held = 0
        for i, n in enumerate(pc.binary_length(sizes).fill_null(0).to_pylist()):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


# ---------------------------------------------------------------- rows by place, order and rank

#: A row's file and its number there.
PLACE = ("__file", "__row")


def located(docs: DataFrame) -> DataFrame:
    """docs with PLACE, which names a row for good: any later scan of the same files gives the same.

    A plan that is more than a scan of Parquet files, filtered and projected, is written first.
    """
    node = docs._jdf.queryExecution().analyzed()
    while node.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().apply(0)
    if node.getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
        except AnalysisException:
            pass  # files without row numbers
    return located(stash(docs, "rows"))


#: A bitmap marks one of 64 * 64 * SLOTS hashes: SLOTS rows of 64 words, 9 MB at most, however many keys there are.
SLOTS = 1 << 14


def may_hold(df: DataFrame, few: DataFrame, keys: Sequence[str], flag: str = "__may") -> DataFrame:
    """Add flag: false only where no row of few has df's keys. A bitmap of hashed keys is broadcast, of fixed size;
    beyond some SLOTS * 1000 keys it tells less and less, and never wrongly."""
    h, bit = F.xxhash64(*keys), F.expr("shiftleft(1L, cast(__h & 63 as int))")
    word = F.shiftrightunsigned("__h", 44).cast("int")
    words = few.select(h.alias("__h")).select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = F.map_from_entries(F.collect_list(F.struct(F.expr("__word & 63"), "__bits")))
    marks = words.groupBy(F.shiftright("__word", 6).alias("__slot")).agg(held.alias("__held"))
    marks = marks.select("__slot", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("__held", i), F.lit(0).cast("long"))).alias("__words"))
    marked = df.withColumn("__h", h).withColumn("__at", F.shiftright(word, 6)).join(F.broadcast(marks), F.col("__at") == F.col("__slot"), "left")
    found = F.get("__words", F.expr("cast(shiftrightunsigned(__h, 44) & 63 as int)")).bitwiseAND(bit) != 0
    return marked.withColumn(flag, F.coalesce(found, F.lit(False))).drop("__h", "__at", "__slot", "__words")


def attach(df: DataFrame, few: DataFrame, keys: Sequence[str] = PLACE) -> DataFrame:
    """df left join few, which has at most one row for keys and no nulls in them. Only rows that a bitmap doesn't
    rule out are shuffled, so where few is small against df, most of df stays where it is read (twice). few grows with
    the data, so it is merged, never broadcast."""
    marked = may_hold(df, few, keys)
    new = [c for c in few.columns if c not in keys]
    alone = marked.where("not __may").select(*df.columns, *[F.lit(None).cast(few.schema[c].dataType).alias(c) for c in new])
    return marked.where("__may").drop("__may").join(few.hint("merge"), list(keys), "left").select(*df.columns, *new).unionByName(alone)


def in_order(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """df sorted as a whole: by ranges, each sorted.

    Ranges are dealt by order and, for rows that are equal in it, by where they come from, so no key, however
    frequent, is one task's work.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "__tie"]
    return df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__tie")


def numbered(df: DataFrame, order: Sequence[str | Column], out: str, total: str, name: str) -> DataFrame:
    """Add out, the place from 0 of each row in order, and total, the number of rows. Native. The rows are written once."""
    rows = in_order(df, order).withColumn("__id", F.monotonically_increasing_id())
    rows = stash(rows.withColumn("__part", F.shiftright("__id", 33).cast("int")), name)
    up_to = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range at most
    bases = rows.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(up_to), F.lit(0)).alias("__base"), F.sum("count").over(Window.partitionBy()).alias(total))
    return rows.join(F.broadcast(bases), "__part").select(*df.columns, (F.col("__base") + F.expr("__id & 8589934591L")).alias(out), total)


def _counted(groups: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, spans = TaskContext.get().partitionId(), None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for g in groups:
                codes = batch.column(g).dictionary_encode(null_encoding="encode").indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            starts = np.concatenate(([0], np.flatnonzero(new)))
            rank = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            end = starts[1] if len(starts) > 1 else batch.num_rows
            key = [batch.column(g)[0].as_py() for g in groups]
            spans = last is None or (spans and key == last)  # the range's first group may go on from the range before
            if key == last:
                rank[:end] += seen
            first = np.zeros(batch.num_rows, bool)
            first[:end] = spans
            spans = spans and end == batch.num_rows
            last, seen = [batch.column(g)[-1].as_py() for g in groups], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(rank, pa.int64()), pa.array(first)], names=[*batch.schema.names, "__part", "__rank", "__first"]
            )

    return count


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], out: str, name: str) -> DataFrame:
    """Add out: the place from 0 of each row in its group, in order. Null is a group like any other.

    Rows are sorted once, in ranges that may cut a group anywhere, counted within each range and written. Only the first
    group of a range can go on from the range before, so there is one base a range.
    """
    sorted_ = in_order(df, [*[F.asc_nulls_last(g) for g in groups], *order])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    rows = stash(sorted_.mapInArrow(_counted(groups), f"{fields}, __part int, __rank long, __first boolean"), name)
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)]
    heads = rows.where("__first and __rank = 0").select("__part", *keys)
    same = F.lit(True)
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    # of the groups that begin a range: their rows in each range, at most two ranges' worth of groups a range
    ends = rows.join(F.broadcast(heads.drop("__part").distinct()), same).groupBy("__part", *[f"__g{i}" for i in range(len(groups))]).agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.partitionBy(*[f"__g{i}" for i in range(len(groups))]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("__part", F.coalesce(F.sum("__n").over(up_to), F.lit(0)).alias("__base"), *[f"__g{i}" for i in range(len(groups))]).withColumn("__first", F.lit(True))
    # of a part's two rows at most, only its first group's has a base: another's rows all stand after the range's start
    bases = bases.where("__base > 0").select("__part", "__first", "__base")
    return rows.join(F.broadcast(bases), ["__part", "__first"], "left").select(*df.columns, (F.col("__rank") + F.coalesce("__base", F.lit(0))).cast("long").alias(out))
