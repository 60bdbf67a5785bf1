"""Exact order statistics of groups of any size by counting (survey A14, A18)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import use_checkpoints

BINS = 1024
#: Rows of a table of groups that are sent to where the values lie; with more groups both sides are dealt by group.
FEW = 100_000


def _few(groups: DataFrame) -> DataFrame:
    """A checkpointed table of groups, marked for broadcast if it is small: few groups have too many values each for a task."""
    return F.broadcast(groups) if groups.limit(FEW + 1).count() <= FEW else groups


def _octaves(v: Column) -> Column:
    """Rises with v, by one for each doubling of its size: what lies between two doubles is at most 4,200."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1076.0))


def _same(left: str, right: str, by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by], F.lit(True))


def order_statistics(df: DataFrame, by: Sequence[str], value: str, ranks: DataFrame, bins: int = BINS) -> DataFrame:
    """(by..., __rank, __value): the value at each rank (from 0) of ranks (by..., __rank) among its group's values.

    Each round counts the values between a rank's bounds in equal bins, and the bin that holds the rank gives the next
    bounds, its own least and greatest value. So a rank costs `bins` counts a round, in every task and in the exchange,
    however many values its group has. Bins are equal in octaves until the bounds are within one, then in value, so there
    are about eight rounds of 1,024 bins at most, whatever the values.
    """
    use_checkpoints(df.sparkSession)
    keys = [*by, "__rank"]
    held = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    held = held.withColumn("__v", F.greatest(F.least("__v", F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308)))
    extent = held.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    open_ = ranks.alias("r").join(extent.alias("e"), _same("r", "e", by)).select(*[f"r.{k}" for k in keys], "__low", "__high", F.lit(0).cast("long").alias("__below")).checkpoint()
    done = []
    while True:
        done.append(open_.where("__low = __high").select(*keys, F.col("__low").alias("__value")))
        left = open_.where("__low < __high")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        low, high, v = F.col("__low"), F.col("__high"), F.col("__v")
        wide = _octaves(high) - _octaves(low) > 1
        share = F.when(wide, (_octaves(v) - _octaves(low)) / (_octaves(high) - _octaves(low))).otherwise((v - low) / (high - low))
        inside = held.alias("h").join(_few(left).alias("o"), _same("h", "o", by) & F.col("__v").between(F.col("__low"), F.col("__high")))
        binned = inside.select(*[F.col(f"o.{k}") for k in keys], "__below", "__v", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int").alias("__bin"))
        counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.first("__below").alias("__start"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("__below", F.col("__start") + before)
        open_ = placed.where((F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__below") + F.col("__n"))).select(*keys, "__low", "__high", "__below").checkpoint()


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], bins: int = BINS) -> DataFrame:
    """(by..., share, quantile): interpolated between the two values beside it, as percentile does, without a table of all values.

    Null and NaN values don't count; infinities count as the greatest doubles; a group without values has no row.
    Null is a group like any other.
    """
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
    wanted = counted.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("__at", F.col("share") * (F.col("__n") - 1))
    wanted = wanted.withColumns({"__rank": F.floor("__at"), "__next": F.ceil("__at")})
    ranks = wanted.select(*by, F.explode(F.array("__rank", "__next")).alias("__rank")).distinct()
    found = order_statistics(df, by, value, ranks, bins)
    one, two = found.alias("a"), found.alias("b")
    w = wanted.alias("w")
    joined = w.join(one, _same("w", "a", by) & (F.col("w.__rank") == F.col("a.__rank"))).join(two, _same("w", "b", by) & (F.col("w.__next") == F.col("b.__rank")))
    low, high = F.col("a.__value"), F.col("b.__value")
    return joined.select(*[F.col(f"w.{c}") for c in by], "share", F.when(low == high, low).otherwise(low + (high - low) * (F.col("__at") - F.col("w.__rank"))).alias("quantile"))


def median_mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by..., median, mad): the median, and the median of the distances from it."""
    medians = exact_quantiles(df, by, value, [0.5]).select(*by, F.col("quantile").alias("median")).checkpoint()
    apart = df.alias("d").join(_few(medians).alias("m"), _same("d", "m", by)).select(*[F.col(f"d.{c}") for c in by], F.abs(F.col(f"d.{value}") - F.col("m.median")).alias("__apart"))
    mads = exact_quantiles(apart, by, "__apart", [0.5])
    return medians.alias("m").join(mads.alias("a"), _same("m", "a", by)).select(*[F.col(f"m.{c}") for c in by], "m.median", F.col("a.quantile").alias("mad"))
