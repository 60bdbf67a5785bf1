"""Keyed look-ups, key-set differences, set operations and ordering helpers (survey J11-J17, F10-F17, U01-U04, O01-O07, R01-R06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import uniform
from .checkpoints import use_checkpoints


def lookup(left: DataFrame, right: DataFrame, on: Sequence[str], strict: bool = False) -> DataFrame:
    """Inner equi-join; with strict a left row without a partner fails the query, like a missing key of a map."""
    if not strict:
        return left.join(right, list(on))
    marked = left.join(right.withColumn("__found", F.lit(True)), list(on), "left")
    missing = F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*on)))).cast("boolean")
    return marked.where(F.coalesce(F.col("__found"), missing)).drop("__found")


def missing_keys(base: DataFrame, candidate: DataFrame, on: Sequence[str]) -> DataFrame:
    return base.select(*on).distinct().join(candidate.select(*on).distinct(), list(on), "left_anti")


def compare_keyed(base: DataFrame, candidate: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Full outer comparison by key: base, candidate, difference and which side lacks the row."""
    a, b = base.select(*on, F.col(value).alias("base")), candidate.select(*on, F.col(value).alias("candidate"))
    joined = a.withColumn("__a", F.lit(1)).join(b.withColumn("__b", F.lit(1)), list(on), "full")
    side = F.when(F.col("__b").isNull(), "no candidate").when(F.col("__a").isNull(), "no base").otherwise("both")
    return joined.select(*on, "base", "candidate", F.abs(F.col("base") - F.col("candidate")).alias("difference"), side.alias("found"))


def alias_match(found: Column, true: Column, factors: Sequence[float] = (1.0, 2.0, 0.5, 3.0, 1 / 3), rtol: float = 0.02) -> Column:
    """Whether found is within rtol of true times one of the factors."""
    return F.exists(F.array(*[F.lit(f) for f in factors]), lambda k: F.abs(found - true * k) <= F.lit(rtol) * true * k)


def with_provenance(parts: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL with the name of each part."""
    frames = [df.withColumn("provenance", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def ring_shift(df: DataFrame, rank: str, size: int, by: int = 1) -> DataFrame:
    """What each rank holds goes to the next one, the last rank's to the first: a key shift, no ordering."""
    return df.withColumn(rank, F.pmod(F.col(rank) + by, F.lit(size)).cast(df.schema[rank].dataType))


def positions(df: DataFrame, *order: str | Column) -> DataFrame:
    """Add position, the place from 0 of each row in order, and __total, the number of rows.

    Rows are sorted by ranges of the whole order, ties dealt by where they come from, as many ranges as the session has shuffle partitions;
    the ranges are checkpointed, and their counts, one each, summed up. No task sorts all rows, however many share a key.
    """
    use_checkpoints(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "__tie"]
    held = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__tie")
    held = held.withColumn("__id", F.monotonically_increasing_id()).checkpoint().withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    bases = held.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    placed = held.join(F.broadcast(bases), "__part")
    return placed.select(*df.columns, (F.col("__base") + F.expr("__id & 8589934591L")).alias("position"), "__total")


def batches(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Split into n consecutive batches of even size, the first ones larger by a row, with a global position."""
    pos, total = F.col("position"), F.col("__total")
    large, size = total % n, F.floor(total / n)
    head = large * (size + 1)
    batch = F.when(pos < head, F.floor(pos / (size + 1))).otherwise(large + F.floor((pos - head) / F.greatest(size, F.lit(1))))
    return positions(df, *order).withColumn("batch", batch.cast("long")).drop("__total")


def take_in_order(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows by a list of keys (pos, key), in the order of the list, repeats included."""
    return wanted.join(rows, key)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, by: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def permuted_order(seed: int, *keys: Column) -> Column:
    """Sort key of a reproducible random order of integer keys."""
    return uniform(seed, *keys)


def morton(x: Column, y: Column, z: Column | None = None, bits: int = 10) -> Column:
    """Interleaved bits of coordinates in [0, 1): nearby points get nearby numbers."""
    axes = [x, y] + ([z] if z is not None else [])
    cells = [F.least(F.greatest(F.floor(a * (1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long") for a in axes]
    terms = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), b * len(axes) + i) for b in range(bits) for i, c in enumerate(cells)]
    out = terms[0]
    for t in terms[1:]:
        out = out.bitwiseOR(t)
    return out


def displacements(df: DataFrame, rank: str, size: str) -> DataFrame:
    """The prefix sums of ragged sizes by rank: where each rank's rows begin in the gathered whole."""
    before = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    return df.groupBy(rank).agg(F.sum(size).alias(size)).withColumn("displacement", F.coalesce(F.sum(size).over(before), F.lit(0)))
