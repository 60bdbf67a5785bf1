"""SimHash near-duplicates: bit-sliced Hamming comparison inside blocks, then connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, PLACE, UPPER, attach, byte_blocks, drop_stash, located, may_hold, neutral, stash, table

BITS, SHINGLE, RADIUS, SEED = 64, 3, 2, 42
#: A pair within RADIUS bits agrees on at least BLOCKS - RADIUS of the BLOCKS bit ranges: one table for each choice.
BLOCKS = 5
#: Fingerprints of a bucket that one task compares with each other; a larger bucket is compared by pairs of such tiles.
TILE = 2048
#: Bytes of text that are shingled at once.
BLOCK_BYTES = 1 << 20
#: Words of 64 distances that are counted at once.
WORDS = 1 << 18
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())

#: Wide fingerprints tell how similar two texts are: bits, words of a shingle, and the distance of two texts that share 0.8 of
#: their shingles, 0.15 of the bits, with one and a half standard deviations on top.
WIDE_BITS, WIDE_SHINGLE, WIDE_RADIUS = 256, 5, 48
#: Such texts agree on a bit by this chance. Tables of so many drawn bits that a bucket holds about BUCKET of all fingerprints,
#: LEAST_KEY bits at least, and as many tables as meet such texts in one by the chance FOUND.
AGREE, FOUND, BUCKET, LEAST_KEY = 0.85, 0.99, 1024, 12


def shingles(text: bytes, k: int) -> list[bytes]:
    """The runs of k words, space-joined, in lower case; all words if they are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
    k = min(k, len(words))
    return [joined[a:b] for a, b in zip(starts[: len(words) - k + 1].tolist(), (starts + lengths)[k - 1 :].tolist(), strict=True)]


def _majority(hashes: Iterator[np.ndarray], bits: int) -> np.ndarray:
    """The bits that more than half of the hashes have, as 64-bit words; hashes come in blocks (n, bits / 8) of bytes."""
    votes, n = np.zeros(bits, np.int64), 0
    for block in hashes:
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(block)
    return np.packbits(2 * votes > n, bitorder="little").view("<u8")


def fingerprint(text: bytes) -> int:
    """Bit b is set if more than half of the hashes of the 3-word shingles, repeats included, have it set."""
    found, digest = shingles(text, SHINGLE), xxhash.xxh64_intdigest
    if not found:
        return 0
    blocks = (np.array([digest(x, SEED) for x in found[at : at + (1 << 16)]], "<u8").view(np.uint8).reshape(-1, 8) for at in range(0, len(found), 1 << 16))
    return int(_majority(blocks, BITS)[0])


def wide_fingerprint(text: bytes) -> bytes:
    """WIDE_BITS bits of the distinct WIDE_SHINGLE-word shingles, by hashes of 128 bits each with a seed of its own."""
    found, digest = list(set(shingles(text, WIDE_SHINGLE))), xxhash.xxh3_128_digest
    seeds = range(SEED, SEED + WIDE_BITS // 128)
    if not found:
        return bytes(WIDE_BITS // 8)
    blocks = (np.frombuffer(b"".join(digest(x, seed) for x in found[at : at + (1 << 14)] for seed in seeds), np.uint8).reshape(-1, WIDE_BITS // 8) for at in range(0, len(found), 1 << 14))
    return _majority(blocks, WIDE_BITS).tobytes()


def _fingerprints(wide: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fingerprint_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in byte_blocks(batches, "text", BLOCK_BYTES):
            texts = block.column("text").cast(pa.binary())
            if wide:
                prints = pa.array([wide_fingerprint(t.as_py()) for t in texts], pa.binary())
            else:
                prints = pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))
            yield block.drop_columns(["text"]).append_column("fp", prints)

    return fingerprint_all


def fingerprints(docs: DataFrame, keep: Sequence[str] = ("doc_id",), wide: bool = False) -> DataFrame:
    """The columns in keep, and fp: the 64 bits as a signed long, or the wide fingerprint as binary. Null text counts as
    empty, whose fingerprint is zero."""
    held = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    return held.mapInArrow(_fingerprints(wide), ", ".join([*(f"`{c}` {held.schema[c].dataType.simpleString()}" for c in keep), f"fp {'binary' if wide else 'long'}"]))


# ---------------------------------------------------------------- bit-sliced comparison


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """planes[b] holds bit b of every fingerprint (n, words), 64 fingerprints to a word; padding bits are zero."""
    n, words = prints.shape
    padded = np.zeros((-(-n // 64) * 64, words), np.uint64)
    padded[:n] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), 8 * words), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(prints: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (i, j), low[i] <= j < high[i], of fingerprints with at most radius differing bits; prints: (n) or (n, words).

    Each word of a plane carries 64 fingerprints. A row's bit, spread over a word, is XORed with the plane,
    and the differences are added into vertical counters by carry-save steps: counter[k] holds bit k of
    64 distances. A last, sticky word marks distances beyond what the counters hold. Words whose distances
    all exceed the radius are abandoned as the bits go by. Rows of many buckets share one call.
    """
    prints = prints[:, None] if prints.ndim == 1 else prints
    planes, every = bit_planes(prints), max(4, prints.shape[1] * 4)
    words = np.maximum(0, -(-high // 64) - low // 64) * (low < high)
    depth = max(1, radius.bit_length())
    found = [(np.zeros(0, np.int64),) * 2]
    ends = np.cumsum(words)
    at = 0
    while at < len(prints):  # rows of about WORDS words at once
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
        i = np.repeat(np.arange(at, to), words[at:to])
        w = np.arange(len(i)) - np.repeat(np.cumsum(words[at:to]) - words[at:to], words[at:to]) + low[i] // 64
        at = to
        first, last = np.maximum(low[i] - w * 64, 0).astype(np.uint64), np.minimum(high[i] - w * 64, 64).astype(np.uint64)
        over = ~((ONES >> (np.uint64(64) - last)) & (ONES << first))  # columns outside [low, high) count as too far
        counter = np.zeros((depth, len(i)), np.uint64)
        for bit in range(len(planes)):
            if not len(i):
                break
            carry = planes[bit, w] ^ (np.uint64(0) - ((prints[i, bit >> 6] >> np.uint64(bit & 63)) & np.uint64(1)))
            for k in range(depth):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if bit % every == every - 1:
                alive = ~(over | _above(counter, radius)) != 0
                if not alive.all():
                    i, w, over, counter = i[alive], w[alive], over[alive], counter[:, alive]
        near = ~(over | _above(counter, radius))
        word, column = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        found.append((i[word], w[word] * 64 + column))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Bits of the distances above radius: a bitwise comparison of the vertical counters with a constant."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], ~np.uint64(0))
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def _forest(i: np.ndarray, j: np.ndarray, prints: Sequence) -> pa.RecordBatch:
    """The pairs as a spanning forest (a, b): what is linked stays linked, by fewer rows than there are fingerprints."""
    up: dict = {}

    def find(x):  # noqa: ANN001, ANN202  a long or bytes
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = up[x]
        return x

    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        a, b = find(prints[a]), find(prints[b])
        if a != b:
            up[max(a, b)] = min(a, b)
    pairs = [(find(x), x) for x in up if find(x) != x]
    kind = pa.binary() if prints and isinstance(prints[0], bytes) else pa.int64()
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], names=["a", "b"])


def _compare(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links inside the groups of a partition that is sorted by group, side and fingerprint.

        A group is a tile, or the two sides of a pair of tiles; it is held whole, so its size bounds what is kept.
        """
        held: list[pa.RecordBatch] = []
        for batch in _then_none(batches):
            rows = pa.Table.from_batches([*held, batch] if batch is not None else held) if held or batch is not None else None
            if rows is None or not rows.num_rows:
                continue
            key = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("t", "k", "left", "right")])
            starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
            done = rows.num_rows if batch is None else int(starts[-1])
            held = [] if batch is None else rows.slice(done).combine_chunks().to_batches()
            if not done:
                continue
            starts = starts[starts < done]
            ends = np.append(starts[1:], done)
            group = np.repeat(np.arange(len(starts)), ends - starts)
            prints, side = rows.column("fp").slice(0, done).to_pylist(), rows.column("side").to_numpy()[:done].astype(np.int64)
            words = np.frombuffer(b"".join(prints), "<u8").reshape(done, -1) if isinstance(prints[0], bytes) else np.array(prints, np.int64).view(np.uint64)
            left, right = key[2, :done], key[3, :done]
            at = np.arange(done)
            # within a tile a row meets the rows after it; of a pair, rows of the left side meet the right side
            n_left = np.bincount(group, weights=side == left, minlength=len(starts)).astype(np.int64)
            low = np.where(left == right, at + 1, starts[group] + n_left[group])
            high = np.where((left == right) | (side == left), ends[group], 0)
            yield _forest(*close_pairs(words, low, high, radius), prints)

    return compare


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _block_key(fp: Column, blocks: tuple[int, ...]) -> Column:
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in blocks)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to connect all that are within RADIUS bits.

    distinct: (fp), no repeats. A table for each way to choose BLOCKS - RADIUS of the BLOCKS bit ranges, 38 bits
    in common or so.
    """
    tables = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    keys = F.array(*[F.struct(F.lit(t).alias("t"), _block_key(F.col("fp"), blocks).alias("k")) for t, blocks in enumerate(tables)])
    return _linked(distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k"), "long", RADIUS, tile, False)


def drawn_bits(n: int) -> np.ndarray:
    """(tables, bits): the bits that are the key of each table for n fingerprints; fixed numbers, whatever the data."""
    k = min(48, max(LEAST_KEY, math.ceil(math.log2(max(1, n) / BUCKET))))
    tables = math.ceil(math.log(1 - FOUND) / math.log(1 - AGREE**k))
    rng = np.random.default_rng(SEED)
    return np.stack([np.sort(rng.permutation(WIDE_BITS)[:k]) for _ in range(tables)])


def _wide_keys(drawn: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def key_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 1 << np.arange(drawn.shape[1], dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = batch.column("fp")
            bits = np.unpackbits(np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1), axis=1, bitorder="little").astype(np.int64)
            for t, positions in enumerate(drawn):
                yield pa.RecordBatch.from_arrays([prints, pa.array(np.full(len(prints), t), pa.int32()), pa.array(bits[:, positions] @ place)], names=["fp", "t", "k"])

    return key_all


def wide_links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct wide fingerprints of WIDE_RADIUS differing bits or fewer, that share a bucket of a table.

    Fingerprints are met in tables of drawn bits (drawn_bits); each pair of a bucket is compared, so a link is missed only where a
    pair meets in none of them: 3 of 100 at a similarity of 0.8, and hardly any at 0.9.
    """
    drawn = drawn_bits(distinct.count())
    return _linked(distinct.select("fp").mapInArrow(_wide_keys(drawn), "fp binary, t int, k long"), "binary", WIDE_RADIUS, tile, True)


def _linked(keyed: DataFrame, kind: str, radius: int, tile: int, crowded: bool) -> DataFrame:
    """Links of the fingerprints (fp, t, k) that share a bucket (t, k), as forests.

    Buckets above `tile` fingerprints are cut by a hash into tiles first and compared pair of tiles by pair of tiles, so no
    task holds more than two tiles, and none is skipped. Where few buckets hold more than one fingerprint, those are told by a join;
    where they are crowded, all are dealt at once, and a bitmap tells the large ones.
    """
    counts = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (tile if crowded else 1))
    sizes = stash(counts.select("t", "k", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "buckets")
    whole = lambda rows: rows.select("t", "k", *[F.lit(0).alias(c) for c in ("left", "right", "side")], "fp")

    def cut(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("side", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
        # a fingerprint of tile s meets every tile r: the group is (min, max) of the two
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return dealt.select("t", "k", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "side", "fp")

    if not crowded:
        dealt = cut(keyed.join(sizes, ["t", "k"]))
    elif sizes.head(1):
        marked = may_hold(keyed, sizes, ("t", "k"))
        large = marked.where("__may").join(sizes.hint("merge"), ["t", "k"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        dealt = whole(marked.where("not __may")).unionByName(cut(large))
    else:
        dealt = whole(keyed)
    dealt = dealt.repartition("t", "k", "left", "right").sortWithinPartitions("t", "k", "left", "right", "side", "fp")
    return dealt.mapInArrow(_compare(radius), f"a {kind}, b {kind}").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node of its component.

    Alternates large-star and small-star steps, each an aggregation and a join of edges, until the edges
    are stars. Each round is written to the shared folder. Rounds grow with the logarithm of the longest path.
    """
    edges = stash(edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).where("root < node").distinct(), "edges")
    digest = lambda rows: rows.select(F.count(F.lit(1)), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first()
    before = digest(edges)
    while True:
        both = edges.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(edges.select(F.col("node").alias("u"), F.col("root").alias("v")))
        # what a node with very many edges is joined with is written first, so that Spark can split its edges
        least = stash(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stash(both.where("v > u").join(least, "u").select(F.col("m").alias("root"), F.col("v").alias("node")).distinct(), "large-stars")
        low = stash(large.groupBy(F.col("node").alias("u")).agg(F.min("root").alias("m")), "low")
        small = large.join(low, large["node"] == low["u"]).select(F.col("m").alias("root"), F.when(F.col("root") == F.col("m"), F.col("node")).otherwise(F.col("root")).alias("node"))
        after = stash(small.where("root < node").distinct(), "edges")
        for done in (edges, least, large, low):
            drop_stash(done)
        edges, held = after, before
        before = digest(edges)
        if before == held:
            return edges.select("node", "root")


def _rooted(prints: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint: the least one of its component, and the least doc_id there."""
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    stars = components(linked(nodes.select("fp")))
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # written, and without the many components of one fingerprint, so that the join below is of plain exchanges, whose hot roots Spark can split
    large = stash(rooted.groupBy("root").agg(F.min("least").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1"), "large-components")
    named = rooted.join(large, "root", "left")
    return stash(named.select("fp", "root", F.when(F.col("n").isNull(), F.col("least")).otherwise(F.col("lowest")).alias("component_id")), "components")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the least doc_id that chains of links of RADIUS bits or fewer reach.

    Documents with equal fingerprints are one node, so a group of copies of any size costs one row from then on;
    nodes are compared in blocks, and components are found over nodes. Documents without words have fingerprint
    zero and are linked like others. A null doc_id counts after all others: it is a component_id only where the whole
    component has no id. Rows that share a doc_id keep a row each. An empty table gives no rows.
    """
    prints = stash(fingerprints(docs), "fingerprints")
    return prints.join(_rooted(prints), "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, similar: bool = True) -> DataFrame:
    """Exactly one row of each group of near-duplicates, with its columns as they are: the one with the least doc_id.

    Texts are near-duplicates that share 0.8 of their five-word shingles or more, as wide fingerprints tell it (wide_links), and
    groups are what chains of them connect. With similar = False they are those of near_duplicates, by 64 bits.

    A null doc_id counts after all others. Of rows that share the least doc_id, the one whose text has the least hash
    stays, and of equal texts the first by file and place there. The rows that go are marked by file and row;
    only they, and few others, are shuffled for that. Texts without words are equal. An empty table gives no rows.
    """
    plain = located(neutral(docs, "doc_id", "text"))
    prints = stash(fingerprints(plain.withColumn("print", F.xxhash64("text")), ("doc_id", "print", *PLACE), similar), "fingerprints")
    rows = prints.join(_rooted(prints, wide_links if similar else links).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print", *PLACE)
    first = stash(rows.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
    places = F.struct(*PLACE)
    go = rows.join(first, "root").where(places != F.struct(*[F.col(f"first.{c}").alias(c) for c in PLACE])).select(*PLACE, F.lit(True).alias("__gone"))
    left = attach(plain, stash(go, "copies")).where("__gone is null")
    return left.drop("__gone", *PLACE).toDF(*docs.columns)


def op7_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
