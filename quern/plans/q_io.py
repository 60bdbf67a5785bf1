"""Queries that write a given table in each format and return what its reader finds there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational
from ..operators.checkpoints import shared_folder
from ..session import table
from ..sources import gridfiles, hdf5, readers, sinks
from ._registry import query


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}.{name}"


@query("SELECT o_orderkey, o_orderkey % 10 = 0 AS missing, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted numbers, every tenth of them `nan`."""
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("nan")).otherwise(F.format_string("%.2f", "o_totalprice"))
    sinks.formatted_csv(table(spark, sf_dir, "orders").select("o_orderkey", price.alias("o_totalprice"), "o_orderpriority"), path := _path(spark, "csv"), {"o_orderkey": "%d"})
    back = readers.csv(spark, path, "o_orderkey long, o_totalprice double, o_orderpriority string")
    return back.select("o_orderkey", F.isnan("o_totalprice").alias("missing"), F.nanvl("o_totalprice", F.lit(0.0)).alias("o_totalprice"), "o_orderpriority")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks.tsv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path := _path(spark, "tsv"))
    return readers.tsv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT c_name AS name, repeat(md5(c_name), 4) AS seq FROM customer")
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence of 128 letters for each customer, broken into lines."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.repeat(F.md5("c_name"), F.lit(4)).alias("seq"))
    sinks.fasta(rows, path := _path(spark, "fasta"))
    return readers.fasta(spark, path)


@query("SELECT p_partkey, p_name, p_size, p_retailprice, 2::BIGINT AS n FROM part")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table appended to itself."""
    rows, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice"), _path(spark, "json")
    sinks.json_lines(rows, path, fresh=True)
    sinks.json_lines(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.groupBy("p_partkey", "p_name", "p_size", "p_retailprice").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, ntile(20) OVER (ORDER BY o_orderkey) - 1 AS batch FROM orders")
def batch_plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in twenty batches of even size, as a plan of one line a batch."""
    dealt = relational.batches(table(spark, sf_dir, "orders").select("o_orderkey"), 20, "o_orderkey")
    sinks.batch_plan(dealt.select("batch", "position", F.col("o_orderkey").alias("idx")), path := _path(spark, "plan"))
    return spark.read.schema("batch long, idx array<long>").json(path).select(F.explode("idx").alias("o_orderkey"), "batch")


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Events by their place in order of event_id, and their number."""
    events = relational.positions(table(spark, sf_dir, "events").select("event_id", "value", "user_id"), "event_id").drop("__total")
    return events, events.count()


_PLACED = "SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value, user_id::DOUBLE AS user_id FROM events"


@query(_PLACED)
def npy_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matrix of two columns."""
    events, n = _numbered(spark, sf_dir)
    cells = events.select(F.col("position").alias("i"), F.posexplode(F.array("value", F.col("user_id").cast("double"))).alias("j", "v"))
    gridfiles.npy(cells, path := _path(spark, "npy"), ["i", "j"], "v", (n, 2))
    readers.register(spark)
    back = spark.read.format("npy").option("rows_per_task", max(1, n // 8)).load(gridfiles.plain(path))
    return back.select("i", F.get("v", F.lit(0)).alias("value"), F.get("v", F.lit(1)).alias("user_id"))


@query(_PLACED)
def netcdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, n = _numbered(spark, sf_dir)
    rows = events.select(F.col("position").alias("i"), "value", F.col("user_id").cast("double").alias("user_id"))
    gridfiles.netcdf(rows, path := _path(spark, "nc"), {"i": n}, {"value": {"units": "1"}, "user_id": {}}, kind=6)
    return gridfiles.read_netcdf(spark, path, ["value", "user_id"])


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value FROM events")
def hdf5_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deflated chunks of a thousand values."""
    events, n = _numbered(spark, sf_dir)
    hdf5.hdf5(events.select(F.col("position").alias("i"), "value"), path := _path(spark, "h5"), "value", ["i"], "value", (n,), (1000,), "<f8")
    return hdf5.read_hdf5(spark, path, "value").select(F.col("i0").alias("i"), F.col("v").alias("value"))
