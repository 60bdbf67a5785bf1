"""Session factory with the settings that the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A local session; on a cluster use the session that spark-submit gives. Partitions default to the cores."""
    cores = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    builder = SparkSession.builder.master(f"local[{cores}]").appName("quern").config("spark.sql.shuffle.partitions", str(partitions or cores))
    for key, value in {"spark.driver.memory": "8g", **SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """A driver table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
