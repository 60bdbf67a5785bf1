"""Windows, runs and sequences (survey W01-W09, T02, T08)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels.order_statistics import sliding_medians


#: Frames of a running median that are one group: longer series are cut, with a frame's overlap on both sides.
FRAMES = 64


def running_median(df: DataFrame, by: Sequence[str], t: str, y: str, half: float, out: str = "trend") -> DataFrame:
    """The exact median of y within half of t on both sides, ends included.

    A series is cut into spans of FRAMES half-widths. A row goes to each span that its reach touches, and has its result in
    its own, so a series of any length is work for many tasks. Along a span two heaps follow the frame, at the logarithm of
    its rows for each row that enters or leaves. Rows without t are a frame of their own. Null and NaN values don't count; a
    frame of none has null.
    """
    span = F.lit(half * FRAMES)
    at = F.floor(F.col(t) / span)
    reach = half * (1.0 + 1e-9)
    spans = F.sequence(F.floor((F.col(t) - F.lit(reach)) / span), F.floor((F.col(t) + F.lit(reach)) / span))
    dealt = df.withColumn("__home", at).withColumn("__span", F.explode_outer(spans))

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(t)
        number = lambda c: rows.column(c).cast(pa.float64()).to_numpy()  # noqa: E731  null becomes NaN
        home, here = rows.column("__home"), rows.column("__span")
        own = pc.or_kleene(pc.equal(home, here), pc.is_null(here)).to_numpy(zero_copy_only=False).astype(bool)
        when = np.zeros(len(rows)) if here[0].as_py() is None else number(t)
        trend = sliding_medians(when, number(y), half, own)
        kept = pa.array(own)
        return rows.filter(kept).drop_columns(["__home", "__span"]).append_column(out, pa.array(trend[own], from_pandas=True))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.groupBy(*by, "__span").applyInArrow(follow, f"{fields}, `{out}` double")


def prefix_mean(df: DataFrame, by: Sequence[str], order: Sequence[str], y: str, out: str = "mean") -> DataFrame:
    return df.withColumn(out, F.avg(y).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def islands(df: DataFrame, by: Sequence[str], position: str, flag: Column) -> DataFrame:
    """(by..., start, length) of the maximal runs of consecutive integer positions where flag holds."""
    w = Window.partitionBy(*by).orderBy(position)
    runs = df.where(flag).select(*by, position, (F.col(position) - F.row_number().over(w)).alias("__g"))
    return runs.groupBy(*by, "__g").agg(F.min(position).alias("start"), F.count("*").alias("length")).drop("__g")


def run_length_sum(df: DataFrame, by: Sequence[str], position: str, flag: Column, least: int) -> DataFrame:
    """Sum of the lengths of runs of at least `least`; groups without one count 0."""
    found = islands(df, by, position, flag).where(F.col("length") >= least).groupBy(*by).agg(F.sum("length").alias("days"))
    return df.select(*by).distinct().join(found, list(by), "left").select(*by, F.coalesce("days", F.lit(0)).alias("days"))


def longest_run(df: DataFrame, by: Sequence[str], position: str, flag: Column) -> DataFrame:
    found = islands(df, by, position, flag).groupBy(*by).agg(F.max("length").alias("days"))
    return df.select(*by).distinct().join(found, list(by), "left").select(*by, F.coalesce("days", F.lit(0)).alias("days"))


def moving_average(df: DataFrame, by: Sequence[str], order: Sequence[str], y: str, k: int, out: str = "smooth") -> DataFrame:
    """Convolution with k equal weights, same length, zeros beyond the ends: divided by k, not by what the frame holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(k // 2), k - 1 - k // 2)
    return df.withColumn(out, F.sum(y).over(w) / k)


def lagged_overlap(pairs: DataFrame, frame: str, on: Sequence[str], lag: int) -> DataFrame:
    """(frame, kept): how many pairs of each frame still exist `lag` frames later."""
    later = pairs.select((F.col(frame) - lag).alias(frame), *on)
    return pairs.join(later, [frame, *on], "left_semi").groupBy(frame).agg(F.count("*").alias("kept"))


def circular_blocks(binned: DataFrame, by: Sequence[str], n_bins: int, widths: Sequence[int]) -> DataFrame:
    """(by..., start, width, s, r): sums of s and r over `width` bins from each start, wrapping round.

    The bins are doubled and summed up once; a block is the difference of two prefix sums.
    """
    doubled = binned.select(*by, F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"), "bin", "s", "r").withColumn("at", F.col("bin") + F.col("turn") * n_bins)
    upto = Window.partitionBy(*by).orderBy("at")
    sums = doubled.select(*by, "at", F.sum("s").over(upto).alias("cs"), F.sum("r").over(upto).alias("cr"))
    ends = sums.select(*by, (F.col("at") + 1).alias("end"), F.col("cs").alias("es"), F.col("cr").alias("er"))
    starts = binned.select(*by, F.col("bin").alias("start"), F.explode(F.array(*[F.lit(k) for k in widths])).alias("width")).withColumn("end", F.col("start") + F.col("width"))
    before = ends.select(*by, F.col("end").alias("start"), F.col("es").alias("bs"), F.col("er").alias("br"))
    found = starts.join(ends, [*by, "end"]).join(before, [*by, "start"], "left")
    return found.select(*by, "start", "width", (F.col("es") - F.coalesce("bs", F.lit(0.0))).alias("s"), (F.col("er") - F.coalesce("br", F.lit(0.0))).alias("r"))
