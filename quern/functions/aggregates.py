"""Aggregations as builders over columns and frames; all are partial on the map side (survey A01-A45)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalar import uniform


def sum_of_squares(x: Column) -> Column:
    return F.sum(x * x)


def composite(x: Column) -> Column:
    """sum(x^2) + mean(x^3) - population deviation."""
    return F.sum(x * x) + F.avg(x * x * x) - F.stddev_pop(x)


def safe_mean(x: Column) -> Column:
    """0 for no values."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def safe_sample_std(x: Column) -> Column:
    """0 for fewer than two values."""
    return F.when(F.count(x) < 2, F.lit(0.0)).otherwise(F.stddev_samp(x))


def describe(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact, interpolated quartiles."""
    c = F.col(column)
    quartiles = [F.percentile(c, p).alias(n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("low"), *quartiles, F.max(c).alias("high"))


def histogram(df: DataFrame, column: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n) for every bin: [e0, e1), ..., the last one closed on the right; values outside are left out.

    Values are compared with the edges themselves, never with a computed bin width.
    """
    x, last = F.col(column), len(edges) - 2
    array = F.array(*[F.lit(float(e)) for e in edges])
    inside = df.where((x >= edges[0]) & (x <= edges[-1]))
    width = (edges[-1] - edges[0]) / (last + 1)
    if all(abs(e - edges[0] - i * width) < 0.25 * width for i, e in enumerate(edges)):
        # even edges: an estimate that is off by one bin at most, put right by the edges themselves
        guess = inside.withColumn("__g", F.least(F.greatest(((x - edges[0]) / width).cast("int"), F.lit(0)), F.lit(last)))
        up = F.when((F.col("__g") < last) & (x >= F.get(array, F.col("__g") + 1)), 1).when(x < F.get(array, F.col("__g")), -1).otherwise(0)
        binned = guess.select((F.col("__g") + up).alias("bin"))
    else:
        binned = inside.select(F.least(F.size(F.filter(array, lambda e: e <= x)) - 1, F.lit(last)).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_bins(df: DataFrame, by: Sequence[str], bin_column: str, n_bins: int, value: Column, weight: Column) -> DataFrame:
    """Sums of weight * value and of weight in each of n_bins bins of each group; empty bins hold zeros."""
    sums = df.groupBy(*by, bin_column).agg(F.sum(weight * value).alias("s"), F.sum(weight).alias("r"))
    groups = df.select(*by).distinct().withColumn(bin_column, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    filled = groups.join(sums, [*by, bin_column], "left")
    return filled.select(*by, bin_column, F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("r", F.lit(0.0)).alias("r"))


def circular_percentile(df: DataFrame, by: Sequence[str], day: str, value: str, p: float, reach: int = 2, period: int = 365) -> DataFrame:
    """The percentile of the values of days within `reach` of each day of the period, which wraps round."""
    near = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    spread = df.select(*by, value, F.col(day).alias("__d"), near.alias("__o")).withColumn(day, F.pmod(F.col("__d") + F.col("__o"), F.lit(period)))
    return spread.groupBy(*by, day).agg(F.percentile(value, p).alias("threshold"))


def median_mad(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """Median, median absolute deviation and significance (max - median) / (1.4826 MAD), 0 where MAD is 0."""
    c = F.col(column)
    medians = df.groupBy(*by).agg(F.percentile(c, 0.5).alias("median"), F.max(c).alias("high"))
    spread = df.join(medians, list(by)).groupBy(*by).agg(F.percentile(F.abs(c - F.col("median")), 0.5).alias("mad"), F.first("median").alias("median"), F.first("high").alias("high"))
    return spread.withColumn("sde", F.when(F.col("mad") <= 0, 0.0).otherwise((F.col("high") - F.col("median")) / (F.lit(1.4826) * F.when(F.col("mad") > 0, F.col("mad")))))


def first_max(payload: Column, value: Column, *order: Column) -> Column:
    """The payload at the greatest value; of equal ones, that with the least order keys, of whatever type. value is a number."""
    return F.min_by(payload, F.when(value.isNotNull(), F.struct(-value, *order)))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [F.count_if(p).alias(n) for n, p in (("tp", predicted & actual), ("fp", predicted & ~actual), ("fn", ~predicted & actual), ("tn", ~predicted & ~actual))]


def share(predicate: Column) -> Column:
    return F.avg(predicate.cast("double"))


def mean_squared_error(predicted: Column, actual: Column) -> Column:
    return F.avg((predicted - actual) * (predicted - actual))


def field_error(a: Column, b: Column) -> list[Column]:
    """Greatest and root-mean-square difference over max |b|, which counts as 1e-12 at least."""
    scale = F.greatest(F.max(F.abs(b)), F.lit(1e-12))
    return [(F.max(F.abs(a - b)) / scale).alias("max_error"), (F.sqrt(F.avg((a - b) * (a - b))) / scale).alias("rms_error")]


def variation(x: Column) -> Column:
    return F.stddev_pop(x) / F.avg(x)


def scatter_add(targets: DataFrame, contributions: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's value plus all contributions to it; contributions to unknown keys are left out."""
    sums = contributions.groupBy(key).agg(F.sum(value).alias("__add"))
    return targets.join(sums, key, "left").withColumn(value, F.col(value) + F.coalesce("__add", F.lit(0.0))).drop("__add")


def first_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order: a partial aggregation, no sort."""
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(key).agg(best.alias("__best")).select(key, "__best.*")


def monte_carlo_mean(spark: SparkSession, f: Callable[[Column], Column], low: float, high: float, n: int, seed: int = 0) -> DataFrame:
    """(high - low) times the mean of f at n hashed uniform points."""
    x = F.lit(low) + F.lit(high - low) * uniform(seed, F.col("id"))
    return spark.range(n).agg((F.lit(high - low) * F.avg(f(x))).alias("integral"))


def monte_carlo_pi(spark: SparkSession, trials: int, n: int, seed: int = 0) -> DataFrame:
    """An estimate of pi for each trial."""
    x, y = uniform(seed, F.col("id")), uniform(seed + 1, F.col("id"))
    return spark.range(trials * n).groupBy((F.col("id") % trials).alias("trial")).agg((F.lit(4.0) * share(x * x + y * y <= 1.0)).alias("pi"))
