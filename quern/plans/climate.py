"""Climate indices of a table (day, lat_i, lon_j, tasmax, pr) in years of 365 days (survey M03, A14-A17, W03-W05)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import circular_percentile
from ..functions.scalar import positive_part
from ..operators.kernels import climate as kernel
from ..operators.windows import longest_run, run_length_sum

CELL = ["lat_i", "lon_j"]
YEAR = [*CELL, "year"]
INDICES = ("tx90p", "hwdi", "gdd", "cdd")


def with_calendar(climate: DataFrame) -> DataFrame:
    return climate.withColumn("year", F.expr("cast(day div 365 as int)")).withColumn("doy", F.expr("cast(day % 365 as int)"))


def indices_by_cell(climate: DataFrame, wanted: Sequence[str] = INDICES, reference_years: int = 30) -> DataFrame:
    """The same rows as indices() by one exchange: a group is one cell's series of whole years, in a kernel.

    The series of a cell is what its years make it, tens of thousands of rows, however many cells there are.
    A cell whose days aren't whole years from day 0, each day once, is an error: those need indices().
    """
    unknown = set(wanted) - set(INDICES)
    if unknown:
        raise ValueError(f"unknown indices: {sorted(unknown)}")
    needed = ["tasmax"] * bool(set(wanted) - {"cdd"}) + ["pr"] * ("cdd" in wanted)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        days = rows["day"].to_numpy()
        order = np.argsort(days)
        years = len(order) // kernel.DAYS
        if len(days) % kernel.DAYS or not np.array_equal(days[order], np.arange(len(days))):
            raise ValueError(f"cell {key} has days missing, repeated or left over from whole years")
        series = {c: rows[c].to_numpy(np.float64)[order].reshape(years, kernel.DAYS) for c in needed}
        found = kernel.indices(series.get("tasmax"), series.get("pr"), tuple(wanted), reference_years)
        blank = np.full(years, np.nan)
        return pd.DataFrame({"lat_i": key[0], "lon_j": key[1], "year": np.arange(years), **{i: found.get(i, blank) for i in INDICES}})

    rows = climate.select("day", *CELL, *needed)
    found = rows.groupBy(*CELL).applyInPandas(one, "lat_i int, lon_j int, year int, tx90p double, hwdi double, gdd double, cdd double")
    return found.select(*YEAR, *[F.coalesce(i, F.lit(float("nan"))).alias(i) for i in INDICES])  # pandas gives NaN as null


def indices(climate: DataFrame, wanted: Sequence[str] = INDICES, reference_years: int = 30) -> DataFrame:
    """A row for each cell and year with the wanted indices, NaN for the others.

    tx90p: share of days above the 90th percentile of the five days round them in the reference years.
    hwdi: days in runs of six or more that are over 5 K warmer than the day's reference mean.
    gdd: sum of what exceeds 283.15 K. cdd: longest run of days under 1 mm. Runs end with the year.
    Only the columns that the wanted indices need are read.
    """
    unknown = set(wanted) - set(INDICES)
    if unknown:
        raise ValueError(f"unknown indices: {sorted(unknown)}")
    needed = ["tasmax"] * bool(set(wanted) - {"cdd"}) + ["pr"] * ("cdd" in wanted)
    days = with_calendar(climate.select("day", *CELL, *[F.col(c).cast("double").alias(c) for c in needed]))
    out = days.select(*YEAR).distinct()
    past = days.where(F.col("year") < reference_years)
    parts = {}
    if "tx90p" in wanted:
        joined = days.join(circular_percentile(past, CELL, "doy", "tasmax", 0.9), [*CELL, "doy"])
        parts["tx90p"] = joined.groupBy(*YEAR).agg((F.count_if(F.col("tasmax") > F.col("threshold")) / F.lit(365.0)).alias("tx90p"))
    if "hwdi" in wanted:
        normal = past.groupBy(*CELL, "doy").agg(F.avg("tasmax").alias("normal"))
        hot = F.col("tasmax") > F.col("normal") + 5.0
        parts["hwdi"] = run_length_sum(days.join(normal, [*CELL, "doy"]), YEAR, "doy", hot, 6).withColumnRenamed("days", "hwdi")
    if "gdd" in wanted:
        parts["gdd"] = days.groupBy(*YEAR).agg(F.sum(positive_part(F.col("tasmax"), 283.15)).alias("gdd"))
    if "cdd" in wanted:
        parts["cdd"] = longest_run(days, YEAR, "doy", F.col("pr") < 1.0).withColumnRenamed("days", "cdd")
    for part in parts.values():
        out = out.join(part, YEAR, "left")
    return out.select(*YEAR, *[F.col(i).cast("double").alias(i) if i in parts else F.lit(float("nan")).alias(i) for i in INDICES])


def extremes(climate: DataFrame, reference_years: int = 30, cold: float = 273.15, wet: float = 1.0) -> DataFrame:
    """(cell, year, frost, r95ptot): days whose temperature stays under `cold`, and the rain of days above the 95th percentile of the
    wet days in the reference years."""
    days = with_calendar(climate.select("day", *CELL, F.col("tasmax").cast("double").alias("t"), F.col("pr").cast("double").alias("pr")))
    heavy = days.where((F.col("year") < reference_years) & (F.col("pr") >= wet)).groupBy(*CELL).agg(F.percentile("pr", 0.95).alias("heavy"))
    total = F.sum(F.when(F.col("pr") > F.col("heavy"), F.col("pr")).otherwise(0.0))
    return days.join(heavy, CELL, "left").groupBy(*YEAR).agg(F.count_if(F.col("t") < cold).alias("frost"), total.alias("r95ptot"))
