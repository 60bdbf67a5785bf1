"""Periodic-box search over a table of light curves (survey M01, V01)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import confusion
from ..operators.kernels import transit as kernel
from ..operators.relational import alias_match
from ..operators.windows import running_median

RESULT = "star_id int, period double, t0 double, duration double, depth double, sde double"


def flatten(curves: DataFrame, window: float = 0.5) -> DataFrame:
    """Flux over its running median within half a window on both sides."""
    return running_median(curves, ["star_id"], "t", "flux", 0.5 * window).withColumn("flux", F.col("flux") / F.col("trend")).drop("trend")


def search(curves: DataFrame, n_periods: int, detrend: bool = True) -> DataFrame:
    """RESULT for each star of (star_id, t, flux, flux_err): one light curve a group, stars in parallel."""
    periods = kernel.period_grid(n_periods)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        power, best = kernel.power_spectrum(*(rows[c].to_numpy(np.float64) for c in ("t", "flux", "flux_err")), periods)
        return pd.DataFrame([(key[0], *best, kernel.significance(power))], columns=["star_id", "period", "t0", "duration", "depth", "sde"])

    return (flatten(curves) if detrend else curves).groupBy("star_id").applyInPandas(one, RESULT)


def periodogram(curves: DataFrame, n_periods: int, detrend: bool = True) -> DataFrame:
    """(star_id, period, power) of every trial period."""
    periods = kernel.period_grid(n_periods)

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t")
        power, _ = kernel.power_spectrum(*(rows[c].to_numpy(np.float64) for c in ("t", "flux", "flux_err")), periods)
        return pd.DataFrame({"star_id": key[0], "period": periods, "power": power})

    return (flatten(curves) if detrend else curves).groupBy("star_id").applyInPandas(one, "star_id int, period double, power double")


def injected(curves: DataFrame, planets: DataFrame) -> DataFrame:
    """Curves with a transit put into the flux of each star of planets (star_id, period, t0, duration, depth)."""
    held = curves.join(planets.select("star_id", F.col("period").alias("p"), F.col("t0").alias("c"), F.col("duration").alias("d"), F.col("depth").alias("h")), "star_id", "left")
    off = F.abs(F.pmod(F.col("t") - F.col("c") + F.col("p") / 2, F.col("p")) - F.col("p") / 2)
    return held.withColumn("flux", F.when(off < F.col("d") / 2, F.col("flux") * (1.0 - F.col("h"))).otherwise(F.col("flux"))).select(*curves.columns)


def recovery(found: DataFrame, truth: DataFrame, threshold: float = 10.0) -> DataFrame:
    """tp, fp, fn, tn of detections; a planet found at a wrong period counts as missed."""
    joined = found.join(truth.select("star_id", "has_planet", F.col("period").alias("true_period")), "star_id")
    planet = F.col("has_planet") == 1
    detected = (F.col("sde") >= threshold) & (~planet | F.coalesce(alias_match(F.col("period"), F.col("true_period")), F.lit(False)))
    return joined.agg(*confusion(detected, planet))
