"""Pairs of sparse rows whose cosine reaches a threshold, without the products of all others (survey M13)."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import shared_folder, use_checkpoints
from .ranges import running_sum

#: What rounding may take from a bound.
SLACK = 1e-9
#: Cells of a row whose sketch goes to the columns of its prefix; longer ones meet others product by product.
ROW_CELLS = 512
#: Rows of a column's block, pairs whose sums a task holds at once, and products that it makes at once.
COLUMN_ROWS, PAIRS, PRODUCTS = 8192, 1 << 22, 1 << 21
#: Buckets in which cells are counted by column and by row, and cells that a task takes of one row.
COLUMN_BUCKETS, ROW_BUCKETS, PART_CELLS = 1 << 16, 1 << 12, 1 << 20
#: A cell of a sketch has WEIGHT_BITS of its value, rounded up, and the other bits of 16 of its column.
WEIGHT_BITS = 5
WEIGHTS, CODES = (1 << WEIGHT_BITS) - 1, 1 << (16 - WEIGHT_BITS)
#: Bytes of sketches that a task makes at once.
SKETCH_BYTES = 1 << 24
#: Cells of a shelf, a range of columns to which a row goes once, and shelves at most; more cells make shelves in parts.
SHELF_CELLS, SHELVES = 1 << 20, 1024


def unit_rows(cells: DataFrame) -> DataFrame:
    """(i, k, v) of the rows over their lengths; cells of one place are added up, zeros and nulls go, and so do rows of zeros."""
    held = cells.where("i is not null and k is not null and v is not null").groupBy("i", "k").agg(F.sum(F.col("v").cast("double")).alias("v")).where("v <> 0")
    lengths = held.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("__length"))
    return held.join(lengths, "i").select("i", "k", (F.col("v") / F.col("__length")).alias("v"))


def prefixes(unit: DataFrame, suffix: float) -> DataFrame:
    """(i, k, v, before, after, left): of each row the cells that stand before a suffix shorter than suffix.

    Cells are ordered from columns that few rows have to those that many have. before and after are the lengths of what stands
    before and after a cell in its row, left that of the suffix.
    """
    rows_of = unit.groupBy("k").agg(F.count(F.lit(1)).alias("__rows"))
    ordered = unit.join(rows_of, "k").withColumn("place", F.struct("__rows", "k"))
    # the squares up to a cell, by ranges, since a row may hold any number of cells
    summed = running_sum(ordered, ["i"], ["place"], F.col("v") * F.col("v"), "__upto")
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    before, after = root(F.col("__upto") - F.col("v") * F.col("v")), root(1.0 - F.col("__upto"))
    from_here = root(1.0 - F.col("__upto") + F.col("v") * F.col("v"))
    held = summed.select("i", "k", "v", before.alias("before"), after.alias("after"), from_here.alias("__from")).where(F.col("__from") >= suffix - SLACK)
    lefts = held.groupBy("i").agg(F.min("after").alias("left"))
    return held.drop("__from").join(lefts, "i")


def candidates(unit: DataFrame, threshold: float, suffix: float | None = None, only: DataFrame | None = None) -> DataFrame:
    """(i, j), i < j: pairs that could reach threshold by what their prefixes say; only: rows (i), one of which is in every pair.

    A suffix shorter than threshold can't reach it with any row of length 1, so a pair shares a cell of its prefixes. At each
    shared cell the cosine is at most the product there and those of the lengths before and after it; over all shared
    cells, it is at most the sum of the products and what one row's suffix adds with the rest of the other. Neither test
    drops a pair that reaches the threshold. A shorter suffix makes more products, and fewer candidates.
    """
    held = prefixes(unit, min(threshold, threshold if suffix is None else suffix))
    met_by = F.col("a.i") < F.col("b.i")
    one, other = held.alias("a"), held.alias("b")
    if only is not None:
        marked = held.join(only.select("i", F.lit(True).alias("__only")), "i", "left").withColumn("__only", F.col("__only").isNotNull())
        one, other = marked.where("__only").alias("a"), marked.alias("b")
        met_by = (F.col("a.i") != F.col("b.i")) & (~F.col("b.__only") | met_by)
    product = F.col("a.v") * F.col("b.v")
    bound = product + F.col("a.before") * F.col("b.before") + F.col("a.after") * F.col("b.after")
    met = one.join(other, (F.col("a.k") == F.col("b.k")) & met_by & (bound >= threshold - SLACK))
    # what two rows share beyond the last of these cells stands in the suffix of one of them
    beyond = F.greatest(F.max("a.left") * F.min("b.after"), F.max("b.left") * F.min("a.after"))
    sums = met.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(product).alias("__sum"), beyond.alias("__rest"))
    return sums.where(F.col("__sum") + F.col("__rest") >= threshold - SLACK).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once as files, which are smaller than a checkpoint's and have a size that joins can go by."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rows(cells: DataFrame) -> DataFrame:
    """(i, cells, square, part): rows as their cells (k, v) and the sum of their squares; cells of one place are added up, zeros and nulls go.

    One exchange, by row. Rows of a bucket that holds PART_CELLS cells more than buckets do on average come in parts (from 1 on) of about
    PART_CELLS, others whole (0).
    """
    held = cells.where("i is not null and k is not null and v is not null").select("i", "k", F.col("v").cast("double").alias("v"))
    bucket = F.pmod(F.xxhash64("i"), F.lit(ROW_BUCKETS))
    counts = {r.bucket: r["count"] for r in held.groupBy(bucket.alias("bucket")).count().collect()}
    mean = sum(counts.values()) / ROW_BUCKETS
    heavy = {b: math.ceil((n - mean) / PART_CELLS) for b, n in counts.items() if n - mean > PART_CELLS}
    row = ["i"]
    if heavy:
        parts = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])[bucket]
        held, row = held.withColumn("part", F.coalesce(F.pmod(F.xxhash64("k"), parts).cast("int") + 1, F.lit(0))), ["i", "part"]
    summed = held.repartition(*row).groupBy(*row, "k").agg(F.sum("v").alias("v")).where("v <> 0")
    rows = summed.groupBy(*row).agg(F.collect_list(F.struct("k", "v")).alias("cells"), F.sum(F.col("v") * F.col("v")).alias("square"))
    return rows if heavy else rows.withColumn("part", F.lit(0))


def _shelves(rows: DataFrame, cells: int) -> tuple[np.ndarray, int]:
    """Where shelves of about as many cells begin in the order of columns that are integers, none for others; and the parts of a shelf."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n = min(max(math.ceil(cells / SHELF_CELLS), 4 * cores), SHELVES)
    columns = rows.select(F.explode("cells.k").alias("k"))
    if not cells or columns.schema["k"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return np.zeros(0, np.int64), 0
    bounds = columns.agg(F.percentile_approx("k", [x / n for x in range(1, n)], 10 * n)).first()[0]
    return np.unique(np.array(bounds, np.int64)), math.ceil(cells / n / SHELF_CELLS)


def _postings(counts: np.ndarray, bounds: np.ndarray, parts: int, threshold: float, above: int, only_above: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, codes, k, v) of length 1 to (key, i, scale, places, sketch): for each run of prefix cells of one shelf the cells from its first on.

    Cells are ordered by the counts of their columns' buckets, to a factor of the root of 2, and then by shelf; the prefix ends where what stands
    from a cell on is shorter than threshold. A cell of a sketch has two bytes, and so has a place of the run, for the rest of its column's
    code. Columns whose buckets count more than above, or all without shelves (parts 0), have runs and keys of their own; only_above: only their keys.
    """
    least, mask, step = max(threshold - SLACK, 0.0) ** 2, len(counts) - 1, SKETCH_BYTES
    level = np.floor(2 * np.log2(np.maximum(counts, 1))).astype(np.int64)

    def shorts(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        held = values[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(held)])

    def records(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = batch.column("codes").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        code, v = (batch.column(c).flatten().to_numpy() for c in ("codes", "v"))
        row = np.repeat(np.arange(len(sizes)), sizes)
        alone = counts[code & mask] > above
        shelf = np.zeros(len(code), np.int64)
        if parts:
            shelf = np.searchsorted(bounds, batch.column("k").flatten().to_numpy(), "right") * parts + (code >> 16 & 0xFFFFFF) % parts
        order = np.lexsort((code, level[code & mask] << 40 | shelf, row))
        code, v, alone, shelf = code[order], np.abs(v[order]), alone[order], shelf[order]
        starts = np.cumsum(sizes) - sizes
        upto = np.concatenate(([0.0], np.cumsum(v * v)))
        at = np.flatnonzero(upto[(starts + sizes)[row]] - upto[:-1] >= least)
        key = np.where(alone, code, shelf) if parts else code
        if only_above:
            yield pa.RecordBatch.from_arrays([pa.array(key[at[alone[at]]])], names=["key"])
            return
        scale = np.nextafter(np.maximum.reduceat(v, starts).astype(np.float32), np.float32(np.inf))
        weight = np.clip(np.ceil(v / scale[row] * WEIGHTS), 1, WEIGHTS).astype(np.uint16)
        cell = (code >> 40 & CODES - 1).astype(np.uint16) << WEIGHT_BITS | weight
        rest = (code >> 20 & 0xFFFF).astype(np.uint16)
        # prefixes are the first cells of their rows, so that neighbours of a run are neighbours here
        new = np.flatnonzero(np.concatenate(([True], (key[at][1:] != key[at][:-1]) | (row[at][1:] != row[at][:-1]))))
        runs, at = np.diff(np.concatenate((new, [len(at)]))), at[new]
        left = (starts + sizes)[row[at]] - at
        ends = np.cumsum(left)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - left[lo] + step // 2, "right")))
            first, of = at[lo:hi], row[at[lo:hi]]
            held = [pa.array(key[first]), batch.column("i").take(pa.array(of)), pa.array(scale[of]), shorts(rest, first, runs[lo:hi]), shorts(cell, first, left[lo:hi])]
            yield pa.RecordBatch.from_arrays(held, names=["key", "i", "scale", "places", "sketch"])
            lo = hi

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from records(batch)

    return postings


def _shorts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of two bytes in all the binaries, and where each begins; the last ends there."""
    held = column.combine_chunks()
    offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64) // 2
    return np.frombuffer(held.buffers()[2], np.uint16, offsets[-1])[offsets[0] :], offsets - offsets[0]


def _met(groups: pa.Table, threshold: float, pairs: int, products: int) -> Iterator[pa.RecordBatch]:
    """(i, j) of the rows of whole groups, one after the other, that meet at a place: pairs of a column, of both its blocks if it has two."""
    sketch, sketches = _shorts(groups.column("sketch"))
    places, runs = _shorts(groups.column("places"))
    record = np.repeat(np.arange(groups.num_rows), np.diff(runs))
    begin = sketches[record] + np.arange(len(record)) - runs[record]
    group, block, mixed, scale = (groups.column(c).to_numpy() for c in ("group", "block", "mixed", "scale"))
    column = (group[record] << 16 | places) << 16 - WEIGHT_BITS | sketch[begin] >> WEIGHT_BITS
    order = np.argsort(column, kind="stable")
    record, begin, column = record[order], begin[order], column[order]
    ids = groups.column("i").combine_chunks()
    starts = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1], [True])))
    cells = np.concatenate(([0], np.cumsum(sketches[record + 1] - begin)))
    cells, starts, counts = np.diff(cells[starts]), starts[:-1], np.diff(starts)
    # a column of one row has no pair; others are met together as long as their pairs and cells are few
    cells, starts, counts = (x[counts > 1] for x in (cells, starts, counts))
    squares = np.cumsum(counts**2 + 2 * cells)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(squares, (squares[lo - 1] if lo else 0) + pairs, "right")))
        some = np.repeat(starts[lo:hi] - np.cumsum(counts[lo:hi]) + counts[lo:hi], counts[lo:hi]) + np.arange(counts[lo:hi].sum())
        of = record[some]
        for one, other in _reaching(np.repeat(np.arange(hi - lo), counts[lo:hi]), sketch, begin[some], sketches[of + 1], scale[of], block[of], mixed[of], threshold, pairs, products):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(of[one])), ids.take(pa.array(of[other]))], names=["i", "j"])
        lo = hi


def _reaching(group: np.ndarray, sketch: np.ndarray, begin: np.ndarray, end: np.ndarray, scale: np.ndarray, block: np.ndarray, mixed: np.ndarray, threshold: float, pairs: int, products: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group, which are sorted by it, whose sketches from begin to end could reach threshold.

    Over cells that share a code, the product of the sums of their weights is no less than that of their values.
    """
    n, sizes = len(group), end - begin
    row = np.repeat(np.arange(n), sizes)
    cell = sketch[np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(len(row))]
    key = group[row] * CODES + (cell >> WEIGHT_BITS)
    order = np.argsort(key, kind="stable")
    key, row, weight = key[order], row[order], ((cell & WEIGHTS) * (scale[row].astype(float) / WEIGHTS))[order]
    # a row's cells of one code are one
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
    key, row, weight = key[first], row[first], np.add.reduceat(weight, first)
    # of each cell the cells of its code in its group that come after it, and of each row the rows of its group that do
    later = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    after = np.searchsorted(group, group, "right") - np.arange(n) - 1
    base = np.concatenate(([0], np.cumsum(after)))
    place, apart = (base[:-1] - np.arange(n) - 1)[row], bool(mixed.any())
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(base, base[a] + pairs, "right")) - 1)
        held = np.flatnonzero((row >= a) & (row < b) & (later > 0))
        ends = np.cumsum(later[held])
        sums = np.zeros(base[b] - base[a])
        lo = 0
        while lo < len(held):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + products, "right")))
            times = later[held[lo:hi]]
            other = np.arange(times.sum()) + np.repeat(held[lo:hi] + 1 - np.cumsum(times) + times, times)
            pair = np.repeat(place[held[lo:hi]] - base[a], times) + row[other]
            product = np.repeat(weight[held[lo:hi]], times) * weight[other]
            if apart:
                # a group of two blocks is met for the pairs between them
                one = np.repeat(row[held[lo:hi]], times)
                product[mixed[one] & (block[one] == block[row[other]])] = 0.0
            low = pair.min()
            found = np.bincount(pair - low, product)
            sums[low : low + len(found)] += found
            lo = hi
        hit = np.flatnonzero(sums >= threshold - SLACK) + base[a]
        if len(hit):
            left = np.searchsorted(base, hit, "right") - 1
            yield left, left + 1 + hit - base[left]
        a = b


def _column_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted records of (key, blocks) groups to their pairs; a task holds groups of about SHELF_CELLS / 8 records, or one."""
    most, products, records = PAIRS, PRODUCTS, max(1, SHELF_CELLS // 8)

    def whole(held: pa.Table, last: bool) -> tuple[pa.Table | None, pa.Table]:
        new = np.zeros(held.num_rows, bool)
        for c in ("key", "bi", "bj"):
            codes = held.column(c).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        end = held.num_rows if last else int(np.flatnonzero(new)[-1]) if new.any() else 0
        return held.slice(0, end).append_column("group", pa.array(np.cumsum(new)[:end])) if end else None, held.slice(end)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting, n = [*waiting, batch], n + batch.num_rows
            if n >= records:
                ready, rest = whole(pa.Table.from_batches(waiting), False)
                if ready is not None:
                    yield from _met(ready, threshold, most, products)
                # what is left of a group is looked at again when as many have come
                waiting, n = rest.to_batches(), 0
        if sum(b.num_rows for b in waiting):
            ready, _ = whole(pa.Table.from_batches(waiting), True)
            yield from _met(ready, threshold, most, products)

    return pairs


def _cosines(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (i, j) with the columns and values of both rows to those (i, j, cosine) whose cosine reaches threshold."""

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pair = [np.repeat(np.arange(batch.num_rows), batch.column(k).value_lengths().to_numpy(zero_copy_only=False)) for k in ("ki", "kj")]
            held = pa.concat_arrays([batch.column(k).flatten() for k in ("ki", "kj")]).dictionary_encode()
            codes = held.indices.to_numpy().astype(np.int64)
            one, other = (p * len(held.dictionary) + c for p, c in zip(pair, np.split(codes, [len(pair[0])]), strict=True))
            _, left, right = np.intersect1d(one, other, assume_unique=True, return_indices=True)
            v, w = (batch.column(c).flatten().to_numpy() for c in ("vi", "vj"))
            sums = np.bincount(pair[0][left], v[left] * w[right], batch.num_rows)
            hit = pa.array(np.flatnonzero(sums >= threshold))
            yield pa.RecordBatch.from_arrays([batch.column("i").take(hit), batch.column("j").take(hit), pa.array(sums).take(hit)], names=["i", "j", "cosine"])

    return cosines


def _short_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(i, j, cosine), i < j, of rows that fit a record: sketches meet at the columns of their prefixes, and cosines are summed for what could reach threshold.

    What is shuffled is a record for each run of a prefix's cells of one shelf, of two bytes for each cell from there on, never one for a product
    or a pair. Where columns near each other have the same rows, a row goes to few shelves; where not, to as many as its prefix has cells.
    A pair's first common column has all that it shares, so a bound from there on loses none. Columns are known by a hash; two of one hash
    only raise bounds. A column of more than COLUMN_ROWS rows is met in pairs of blocks.
    """
    kind = rows.schema["i"].dataType.simpleString()
    at = F.pmod(F.xxhash64("k"), F.lit(COLUMN_BUCKETS)).cast("int")
    counted = rows.select(F.explode("cells.k").alias("k")).groupBy(at.alias("bucket")).count().toArrow()
    counts = np.zeros(COLUMN_BUCKETS, np.int64)
    counts[counted.column("bucket").to_numpy()] = counted.column("count").to_numpy()
    above = max(COLUMN_ROWS, 2 * int(counts.mean()))
    bounds, parts = _shelves(rows, int(counts.sum()))
    unit = rows.select("i", F.col("cells.k").alias("k"), F.transform("cells.v", lambda v: v / F.sqrt("square")).alias("v"))
    coded = unit.select("i", F.transform("k", lambda k: F.xxhash64(k)).alias("codes"), "k", "v")
    places = coded.mapInArrow(_postings(counts, bounds, parts, threshold, above), f"key long, i {kind}, scale float, places binary, sketch binary")
    places = places.withColumn("block", F.lit(0)).withColumn("bi", F.lit(0)).withColumn("bj", F.lit(0))
    if counts.max(initial=0) > above:
        met = coded.mapInArrow(_postings(counts, bounds, parts, threshold, above, True), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        # a row for each COLUMN_ROWS cells at most
        hot = met.where(F.col("n") > COLUMN_ROWS).select("key", F.ceil(F.col("n") / COLUMN_ROWS).cast("int").alias("blocks"))
        blocks = F.coalesce("blocks", F.lit(1))
        places = places.join(F.broadcast(hot), "key", "left").withColumn("block", F.pmod(F.xxhash64("i"), blocks).cast("int"))
        places = places.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o")).drop("o", "blocks")
    group = ["key", "bi", "bj"]
    met = places.repartition(*group).sortWithinPartitions(*group).withColumn("mixed", F.col("bi") != F.col("bj")).mapInArrow(_column_pairs(threshold), f"i {kind}, j {kind}")
    pairs = _kept(met.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct(), "pairs")
    left, right = (unit.select(F.col("i").alias(x), F.col("k").alias(f"k{x}"), F.col("v").alias(f"v{x}")) for x in "ij")
    # rows without a pair are not shuffled where pairs are few
    return pairs.join(left, "i").join(right.join(pairs, "j", "left_semi"), "j").mapInArrow(_cosines(threshold), f"i {kind}, j {kind}, cosine double")


def similarity_join(cells: DataFrame, threshold: float, suffix: float | None = None) -> DataFrame:
    """(i, j, cosine), i < j: all pairs of sparse rows (i, k, v) whose cosine is at least threshold (above 0).

    Prefix filtering: only rare columns bring pairs together, as sketches whose bound says which of them could reach the threshold, and the
    cosines of these are summed exactly from all cells. Rows of more than ROW_CELLS cells have no sketch: pairs with such a row are met
    product by product, bounds drop most of these, and what is left is verified exactly. suffix: the length of what a row leaves out of its prefix in that way,
    the threshold at most and by default. Joins are plain exchanges, so AQE splits rows and columns with very many
    cells; the columns that most rows have are in almost no prefix. Rows without cells have no partner.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold must be above 0 and at most 1, not {threshold}")
    use_checkpoints(cells.sparkSession)
    rows = _kept(_rows(cells), "rows")
    is_long = (F.col("part") > 0) | (F.size("cells") > ROW_CELLS)
    found = _short_pairs(rows.where(~is_long), threshold)
    long = rows.where(is_long).select("i").distinct()
    if long.isEmpty():
        return found
    long = long.checkpoint()
    unit = unit_rows(rows.select("i", F.explode("cells").alias("cell")).select("i", "cell.k", "cell.v")).checkpoint()
    pairs = candidates(unit, threshold, suffix, long).checkpoint()
    left = pairs.join(unit, "i")
    both = left.join(unit.select(F.col("i").alias("j"), "k", F.col("v").alias("__w")), ["j", "k"])
    products = both.groupBy("i", "j").agg(F.sum(F.col("v") * F.col("__w")).alias("cosine"))
    return found.unionByName(products.where(F.col("cosine") >= threshold).select("i", "j", "cosine"))
