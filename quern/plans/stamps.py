"""Cut-outs round catalogue positions (survey M06, F12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import first_footprint

#: The planes of a detector and what fills a cut-out beyond its edge (fixed values).
PLANES = {"sci": 0, "rms": 0, "flg": 1, "bkg": 0, "wgt": 0, "seg": 0}


def locate(catalog: DataFrame, detectors: DataFrame, edge: float = 0.0) -> DataFrame:
    """catalog (id, x, y) with the first detector (det_num, x0, y0, nx, ny) that holds the position, null outside all."""
    found = first_footprint(catalog, detectors, "det_num", edge)
    return catalog.join(found, "id")


def stamps(catalog: DataFrame, detectors: DataFrame, pixels: DataFrame, size: int = 400, edge: float = 0.0) -> DataFrame:
    """(id, det_num, sy, sx, planes...) of the size x size pixels centred on each located position.

    Pixels come by an equi-join on tiles of the detector; cells beyond its edge are filled. Sources outside all
    detectors have no rows. Planes that pixels lack stay null everywhere, also beyond the edge.
    """
    planes = [p for p in PLANES if p in pixels.columns]
    placed = locate(catalog, detectors, edge).where("det_num is not null").join(detectors.select("det_num", "x0", "y0"), "det_num")
    corner = lambda c: (F.rint(F.col(c) - F.col(f"{c}0")) - size // 2).cast("int")
    grid = placed.select("id", "det_num", corner("x").alias("cx"), corner("y").alias("cy"))
    grid = grid.withColumn("sy", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("sx", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    grid = grid.withColumns({"y": F.col("cy") + F.col("sy"), "x": F.col("cx") + F.col("sx")})
    joined = grid.join(pixels.withColumn("__in", F.lit(True)), ["det_num", "y", "x"], "left")
    values = [F.when(F.col("__in"), F.col(p)).otherwise(F.lit(PLANES[p])).alias(p) if p in planes else F.lit(None).cast("double").alias(p) for p in PLANES]
    return joined.select("id", "det_num", "sy", "sx", *values)
