"""Comparison of results with a baseline, by rule and tolerance (survey V01-V07, A42-A44)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tolerance:
    """Values agree within absolute + relative * |baseline|; both zero asks for equality. NaN agrees with NaN."""

    absolute: float = 0.0
    relative: float = 0.0


#: What each result may differ by.
TOLERANCES: Mapping[str, Tolerance] = {
    "tx90p": Tolerance(1e-9),
    "hwdi": Tolerance(1e-9),
    "cdd": Tolerance(1e-9),
    "gdd": Tolerance(0.0, 1e-10),
    "period": Tolerance(0.0, 0.02),
    "score": Tolerance(),
    "hist": Tolerance(),
    "hbonds": Tolerance(),
    "q": Tolerance(1e-12),
}


def _agree(a: Column, b: Column, t: Tolerance) -> Column:
    both_nan = F.isnan(a) & F.isnan(b)
    return both_nan | (F.abs(a - b) <= F.lit(t.absolute) + F.lit(t.relative) * F.abs(a))


def regression(base: DataFrame, candidate: DataFrame, on: Sequence[str], values: Sequence[str], tolerances: Mapping[str, Tolerance] = TOLERANCES) -> DataFrame:
    """A row for each value: (value, compared, missing, extra, differing, worst, ok). One full join by key serves all values."""
    a = base.select(*on, *[F.col(v).cast("double").alias(f"a_{v}") for v in values], F.lit(True).alias("in_a"))
    b = candidate.select(*on, *[F.col(v).cast("double").alias(f"b_{v}") for v in values], F.lit(True).alias("in_b"))
    joined = a.join(b, list(on), "full")
    both = F.col("in_a") & F.col("in_b")
    sums = [F.count_if(F.col("in_b").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("extra"), F.count_if(both).alias("compared")]
    for v in values:
        x, y = F.col(f"a_{v}"), F.col(f"b_{v}")
        agree = F.coalesce(_agree(x, y, tolerances.get(v, Tolerance())), x.isNull() & y.isNull())
        sums += [F.count_if(both & ~agree).alias(f"d_{v}"), F.max(F.when(both & ~F.isnan(x) & ~F.isnan(y), F.abs(x - y))).alias(f"w_{v}")]
    total = joined.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"d_{v}").alias("differing"), F.col(f"w_{v}").alias("worst")) for v in values]))
    ok = (F.col("r.differing") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0)
    return total.select(rows.alias("r"), "compared", "missing", "extra").select("r.value", "compared", "missing", "extra", "r.differing", "r.worst", ok.alias("ok"))


def lattice_physics(cells: DataFrame) -> DataFrame:
    """One row of checks on (ux, uy, rho, solid): mass drift at most 5 %, nothing moves in walls, speeds finite and below 0.5."""
    drift = F.abs(F.avg("rho") - 1.0)
    wall = F.max(F.when(F.col("solid"), F.greatest(F.abs("ux"), F.abs("uy"))).otherwise(0.0))
    top, lost = F.max(F.abs("ux")), F.count_if(F.isnan("ux") | F.isnan("uy") | F.isnan("rho"))
    return cells.agg(drift.alias("drift"), wall.alias("wall_speed"), top.alias("top_speed"), lost.alias("not_finite"), ((drift <= 0.05) & (wall <= 1e-12) & (top <= 0.5) & (lost == 0)).alias("ok"))


def trajectory_sanity(distribution: DataFrame, bonds: DataFrame, fractions: DataFrame) -> DataFrame:
    """One row: first peak between 0.24 and 0.34, g at most 0.05 below 0.15, bonds vary by a quarter at most, Q at least 0.7."""
    peak = distribution.agg(F.max_by("r", F.struct("g", -F.col("bin"))).alias("peak"), F.max(F.when(F.col("r") < 0.15, F.col("g"))).alias("core"))
    cv = bonds.agg((F.stddev_pop("hbonds") / F.greatest(F.avg("hbonds"), F.lit(1e-9))).alias("variation"))
    low = fractions.agg(F.min("q").alias("least_q"))
    ok = F.col("peak").between(0.24, 0.34) & (F.coalesce("core", F.lit(0.0)) <= 0.05) & (F.col("variation") <= 0.25) & (F.col("least_q") >= 0.7)
    return peak.crossJoin(cv).crossJoin(low).withColumn("ok", ok)  # one row each


def predicted_bytes(n: int, m: int, d: int, width: int = 8) -> int:
    """What an (n, m, d) broadcast difference would hold in memory: why pairs are compared in blocks."""
    return n * m * d * width
