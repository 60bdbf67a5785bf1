"""One tridiagonal system over many tasks: ranges eliminated by themselves, joined by their ends (survey W17, M11)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import group_starts, sorted_ranges

#: Rows that are eliminated one after the other; a range's blocks of so many rows are eliminated side by side.
BLOCK = 256


def eliminate(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks (block, row), each a tridiagonal system with a neighbour on both sides: g, v and w, by which its solution is
    g + v * (what stands before it) + w * (what stands after it)."""
    right = np.stack((d, np.zeros_like(d), np.zeros_like(d)))
    right[1, :, 0], right[2, :, -1] = -a[:, 0], -c[:, -1]
    n = d.shape[1]
    slope = np.empty_like(d)
    for i in range(n):
        pivot = b[:, i] - (a[:, i] * slope[:, i - 1] if i else 0.0)
        if not pivot.all():
            raise ZeroDivisionError("a pivot is zero: the system must be diagonally dominant or positive definite")
        slope[:, i] = c[:, i] / pivot
        right[:, :, i] = (right[:, :, i] - (a[:, i] * right[:, :, i - 1] if i else 0.0)) / pivot
    for i in range(n - 2, -1, -1):
        right[:, :, i] -= slope[:, i] * right[:, :, i + 1]
    return right[0], right[1], right[2]


def couple(g: np.ndarray, v: np.ndarray, w: np.ndarray, before: float = 0.0, after: float = 0.0) -> np.ndarray:
    """First and last value (block, 2) of blocks in a row, from those of g, v and w (block, 2) and what stands at both ends."""
    n = len(g)
    known, slope = np.empty((n, 2)), np.empty((n, 2))
    p, q = before, 0.0  # the last value of the block before is p + q * (the first of this one)
    for i in range(n):
        scale = 1.0 - v[i, 0] * q
        known[i, 0], slope[i, 0] = (g[i, 0] + v[i, 0] * p) / scale, w[i, 0] / scale
        known[i, 1], slope[i, 1] = g[i, 1] + v[i, 1] * (p + q * known[i, 0]), w[i, 1] + v[i, 1] * q * slope[i, 0]
        p, q = known[i, 1], slope[i, 1]
    out = np.empty((n, 2))
    for i in range(n - 1, -1, -1):
        out[i] = known[i] + slope[i] * after
        after = out[i, 0]
    return out


class Range:
    """The rows of a range, in blocks; rows that fill the last one stand alone and are zero."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        self.n = len(d)
        blocks = -(-self.n // BLOCK)
        fill = lambda x, with_: np.append(x, np.full(blocks * BLOCK - self.n, with_)).reshape(blocks, -1)
        a, b, c, d = fill(a, 0.0), fill(b, 1.0), fill(c, 0.0), fill(d, 0.0)
        # what follows the range belongs to its last row, wherever that stands in its block
        self.tail = c.ravel()[self.n - 1]
        c.ravel()[self.n - 1] = 0.0
        self.g, self.v, self.w = eliminate(a, b, c, d)
        e = np.zeros_like(d)
        e.ravel()[self.n - 1] = -self.tail
        # only the last block feels what follows
        self.h = np.zeros_like(d)
        self.h[-1] = eliminate(a[-1:], b[-1:], c[-1:], e[-1:])[0][0]

    def solve(self, before: float, after: float) -> np.ndarray:
        g = self.g + self.h * after
        ends = couple(*(x[:, [0, -1]] for x in (g, self.v, self.w)), before, 0.0)
        left, right = np.append(before, ends[:-1, 1]), np.append(ends[1:, 0], 0.0)
        return (g + self.v * left[:, None] + self.w * right[:, None]).ravel()[: self.n]

    def ends(self) -> list[float]:
        """g, v and w of the range's first and last row."""
        nothing = self.solve(0.0, 0.0)
        rows = [nothing, self.solve(1.0, 0.0) - nothing, self.solve(0.0, 1.0) - nothing]
        return [float(x[k]) for x in rows for k in (0, -1)]


def _read(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> tuple[pa.Table, Range] | None:
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return None
    whole = table.combine_chunks().to_batches(max_chunksize=table.num_rows)[0]
    a, b, c, d = (whole.column(x).to_numpy(zero_copy_only=False).astype(np.float64).copy() for x in ("__a", "__b", "__c", "__d"))
    new = group_starts(whole, by)
    a[new], c[:-1][new[1:]] = 0.0, 0.0  # systems don't touch each other
    return whole, Range(a, b, c, d)


def solve_tridiagonal_ranges(systems: DataFrame, by: Sequence[str], order: Sequence[str | Column], bands: tuple[Column, Column, Column, Column], out: str = "x") -> DataFrame:
    """Add out, the solution of a x[i-1] + b x[i] + c x[i+1] = d along each system's order; bands are a, b, c and d.

    The rows of all systems are one sequence of sorted ranges, so a system of any size is the work of many tasks and small ones
    share a task. A range is eliminated as if what stands before and after it were known; six numbers of each range come
    to the driver, where the values at the ranges' ends follow, and each range puts them in. a of a system's first row and c of
    its last don't count. No pivoting: for diagonally dominant or positive definite systems. Rows with a null band fail.
    """
    held = systems.select("*", *[F.coalesce(x.cast("double"), F.raise_error(F.lit("a band is null")).cast("double")).alias(n) for x, n in zip(bands, ("__a", "__b", "__c", "__d"), strict=True)])
    rows = sorted_ranges(held, [*[F.asc_nulls_first(c) for c in by], *order])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (read := _read(batches, by)) is not None:
            yield pa.RecordBatch.from_arrays([read[0].column("__range")[:1], *[pa.array([x]) for x in read[1].ends()]], names=["__range", "g0", "g1", "v0", "v1", "w0", "w1"])

    key = F.struct(*by) if by else F.lit(0)
    borders = rows.groupBy("__range").agg(F.min_by(key, "__at").alias("first"), F.max_by(key, "__at").alias("last"))
    found = sorted(rows.mapInArrow(reduce, "__range int, g0 double, g1 double, v0 double, v1 double, w0 double, w1 double").join(borders, "__range").collect(), key=lambda r: r["__range"])
    g, v, w = (np.array([[r[f"{x}0"], r[f"{x}1"]] for r in found]).reshape(-1, 2) for x in "gvw")
    apart = [i for i in range(1, len(found)) if found[i].first != found[i - 1].last]
    for i in apart:
        v[i], w[i - 1] = 0.0, 0.0
    ends = couple(g, v, w)
    alone = {0, *apart, len(found)}
    around = {r["__range"]: (0.0 if i in alone else float(ends[i - 1, 1]), 0.0 if i + 1 in alone else float(ends[i + 1, 0])) for i, r in enumerate(found)}
    names = systems.columns

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (read := _read(batches, by)) is not None:
            whole, own = read
            x = own.solve(*around[whole.column("__range")[0].as_py()])
            for start in range(0, whole.num_rows, 1 << 14):
                part = whole.slice(start, 1 << 14)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(x[start : start + (1 << 14)])], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in systems.schema)
    return rows.mapInArrow(finish, f"{fields}, `{out}` double")


def smoothed(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], y: Column, stiffness: float, out: str) -> DataFrame:
    """Add out, the x that makes the squares of x - y and stiffness times those of x's steps least, along each group's order:
    a smoothing spline of first order, one tridiagonal system for each group. y has no nulls.

    Where a group begins and ends is known once its rows are sorted: a step more on either side is added, with x the same there.
    """
    from .ranges import scan

    one = F.lit(1.0)
    counted = scan(df, by, order, one, one, one, "__place")
    sizes = counted.groupBy(*by).agg(F.max("__place").alias("__last"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    rows = counted.alias("r").join(sizes.alias("s"), same) if by else counted.alias("r").crossJoin(F.broadcast(sizes).alias("s"))
    rows = rows.select("r.*", "s.__last")
    inner = (F.col("__place") > 1).cast("double") + (F.col("__place") < F.col("__last")).cast("double")
    off = F.lit(-float(stiffness))
    return solve_tridiagonal_ranges(rows, by, ["__place"], (off, one + F.lit(float(stiffness)) * inner, off, y), out).drop("__place", "__last")
