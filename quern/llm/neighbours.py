"""Approximate nearest neighbours by inner product: a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import in_order, stash, table

NEAREST = 20
TREES = 4
#: Rows that a leaf holds, about: a tree has one level for each doubling of the rows beyond it.
LEAF = 512
#: Rows that the splits are fitted on; nodes with fewer than NODE_SAMPLE of them split at their direction's median.
SAMPLE, NODE_SAMPLE = 1 << 14, 32
#: Leaves are visited until this share of the true neighbours of so many queries is met.
RECALL, CALIBRATION = 0.95, 64
#: Vectors and queries that are compared in one product.
BLOCK, QUERY_BLOCK = 1024, 256
#: Results that a task holds before it gives them out.
HELD = 1 << 20


@dataclass
class Forest:
    """Trees whose levels each have a direction of their own; a node goes right where the projection is above its threshold.

    Vectors have one coordinate more, which brings all to the length of the longest, and queries are scaled to that length:
    the largest inner product is then the least distance.
    """

    scale: float
    longest: float
    directions: np.ndarray  # tree, level, dimension + 1
    thresholds: list[list[np.ndarray]]  # tree, level, node; one threshold for all nodes of a level beyond the sample

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        x = rows / self.scale
        return np.column_stack((x, np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))))

    def projected(self, query: np.ndarray) -> list[list[float]]:
        q = query / self.scale
        return (self.directions[:, :, :-1] @ (q * (self.longest / np.linalg.norm(q)))).tolist()

    def threshold(self, tree: int, level: int, node: int | np.ndarray) -> float | np.ndarray:
        held = self.thresholds[tree][level]
        return held[node] if len(held) > 1 else held[0]

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: row, tree."""
        x = self.lifted(rows)
        found = np.zeros((len(rows), len(self.directions)), np.int64)
        for t, directions in enumerate(self.directions):
            for level, side in enumerate((x @ directions.T).T):
                found[:, t] = 2 * found[:, t] + (side > self.threshold(t, level, found[:, t]))
        return found

    def visits(self, query: np.ndarray) -> Iterator[tuple[int, int]]:
        """All leaves of all trees, by one queue: first those with the least squared distance to the borders of their boxes."""
        sides = self.projected(query)
        queue = [(0.0, t, 0, 0) for t in range(len(self.directions))]
        while queue:
            so_far, t, start, node = heapq.heappop(queue)
            for level in range(start, self.depth):
                margin = sides[t][level] - self.threshold(t, level, node)
                near = int(margin > 0)
                heapq.heappush(queue, (so_far + margin * margin, t, level + 1, 2 * node + 1 - near))
                node = 2 * node + near
            yield t, node


def fit(sample: np.ndarray, scale: float, longest: float, depth: int, trees: int = TREES, seed: int = 0) -> Forest:
    """Directions at right angles to each other, as far as there are dimensions; thresholds are medians of the sample's nodes."""
    rng, size = np.random.default_rng(seed), sample.shape[1] + 1
    directions = np.empty((trees, depth, size))
    for t in range(trees):
        drawn = [np.linalg.qr(rng.standard_normal((size, size)))[0].T for _ in range(-(-depth // size))]
        directions[t] = np.concatenate(drawn)[:depth] if drawn else directions[t]
    forest = Forest(scale, longest, directions, [[] for _ in range(trees)])
    x, fitted = forest.lifted(sample), max(0, math.ceil(math.log2(max(1, len(sample) / NODE_SAMPLE))))
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for level, side in enumerate((x @ directions[t].T).T):
            middle = float(np.median(side))
            at = np.full(1 << level if level < fitted else 1, middle)
            if level < fitted:
                order = np.lexsort((side, node))
                starts = np.searchsorted(node[order], np.arange(len(at) + 1))
                for i in np.flatnonzero(np.diff(starts) >= NODE_SAMPLE):
                    at[i] = side[order[(starts[i] + starts[i + 1] - 1) // 2]]
            forest.thresholds[t].append(at)
            node = 2 * node + (side > forest.threshold(t, level, node if level < fitted else 0))
    return forest


# ---------------------------------------------------------------- rows in and out of tasks


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _indexer(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, leaf in enumerate(forest.leaves(_matrix(batch.column("v"))).T):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(leaf), *[batch.column(c) for c in ("id", "h", "v")]], names=["tree", "leaf", "id", "h", "v"])

    return index


def _visitor(forest: Forest, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("v"))
            for start in range(0, batch.num_rows, QUERY_BLOCK):
                found = [np.array(list(islice(forest.visits(q), n)), np.int64).reshape(-1, 2) for q in rows[start : start + QUERY_BLOCK]]
                times = [len(f) for f in found]
                taken = batch.slice(start, len(times)).take(pa.array(np.repeat(np.arange(len(times)), times)))
                tree, leaf = np.concatenate(found).T
                yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(leaf), *[taken.column(c) for c in ("id", "h", "v")]], names=["tree", "leaf", "id", "h", "v"])

    return visit


def _packer(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of one leaf that follow each other, up to size of them, as one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, leaf = (batch.column(c).to_numpy() for c in ("tree", "leaf"))
            runs = np.append(np.concatenate(([0], np.flatnonzero((np.diff(tree) != 0) | (np.diff(leaf) != 0)) + 1)), batch.num_rows)
            starts = np.concatenate([np.arange(s, e, size) for s, e in zip(runs[:-1], runs[1:], strict=True)])
            ends = np.append(starts[1:], batch.num_rows)
            values = _matrix(batch.column("v")).astype(np.float32 if batch.schema.field("v").type.value_type == pa.float32() else np.float64)
            columns = [[x[s:e].tobytes() for s, e in zip(starts, ends, strict=True)] for x in (batch.column("id").to_numpy(), batch.column("h").to_numpy(), values)]
            yield pa.RecordBatch.from_arrays([pa.array(tree[starts]), pa.array(leaf[starts]), *[pa.array(c, pa.binary()) for c in columns]], names=["tree", "leaf", "ids", "hs", "vs"])

    return pack


def best_of(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its n best vectors: their places, the queries', and the inner products, summed in the order of the
    coordinates so that a pair's is the same wherever it is taken. Ties go to the smaller id."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = queries @ vectors.T
        slack = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0)
        if near.shape[1] > n:
            least = np.partition(near, -n, axis=1)[:, -n]
            q, v = np.nonzero(~(near < (least - slack)[:, None]))
        else:
            q, v = (x.ravel() for x in np.indices(near.shape))
        score = np.zeros(len(q))
        for d in range(queries.shape[1]):
            score += queries[q, d] * vectors[v, d]
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return v[place < n], q[place < n], score[place < n]


def merged(rows: np.ndarray, n: int) -> np.ndarray:
    """Of rows (query_id, qh, down, id, h): each query's first n by down and id, none twice."""
    rows = rows[np.lexsort([rows[c] for c in ("h", "id", "down", "qh", "query_id")])]
    rows = rows[np.append(True, rows[1:] != rows[:-1])] if len(rows) else rows
    query = np.flatnonzero(np.append(True, (rows["query_id"][1:] != rows["query_id"][:-1]) | (rows["qh"][1:] != rows["qh"][:-1]))) if len(rows) else np.empty(0, int)
    return rows[np.arange(len(rows)) - np.repeat(query, np.diff(np.append(query, len(rows)))) < n]


_FOUND = np.dtype([("query_id", np.int64), ("qh", np.int64), ("down", np.float64), ("id", np.int64), ("h", np.int64)])


def _scorer(dtype: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A query's best of all the leaves that a task compares it with; what a task holds is given out at HELD rows."""

    def batch_of(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[c]) for c in _FOUND.names], names=list(_FOUND.names))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, waiting = np.empty(0, _FOUND), [], 0
        for batch in batches:
            for ids, hs, vs, q_ids, q_hs, qs in zip(*[batch.column(c) for c in ("ids", "hs", "vs", "q_ids", "q_hs", "qs")], strict=True):
                ids, hs, q_ids, q_hs = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, hs, q_ids, q_hs))
                vectors, queries = (np.frombuffer(x.as_buffer(), dtype).reshape(k, -1).astype(np.float64) for x, k in ((vs, len(ids)), (qs, len(q_ids))))
                v, q, found = best_of(queries, vectors, ids, n)
                part = np.empty(len(q), _FOUND)
                for c, x in zip(_FOUND.names, (q_ids[q], q_hs[q], 0.0 - found, ids[v], hs[v]), strict=True):
                    part[c] = x
                parts.append(part)
                waiting += len(part)
                if waiting > HELD:
                    held, parts, waiting = merged(np.concatenate([held, *parts]), n), [], 0
                    if len(held) > HELD:
                        yield batch_of(held)
                        held = held[:0]
        yield batch_of(merged(np.concatenate([held, *parts]), n))

    return score


def _measured(forest: Forest, queries: np.ndarray, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n best of a task's vectors for each of a few queries, with their leaves; a query's own vector isn't among them."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column("v"))
                v, q, score = best_of(queries, rows, batch.column("id").to_numpy(), n + 1)
                other = (rows[v] != queries[q]).any(axis=1)
                v, q, score = v[other], q[other], score[other]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(-score), batch.column("id").take(pa.array(v)), pa.array(forest.leaves(rows[v]).tolist(), pa.list_(pa.int64()))], names=["query", "down", "id", "leaves"])

    return measure


def calibrate(vectors: DataFrame, queries: DataFrame, forest: Forest, n: int, recall: float, size: int) -> int:
    """How many leaves a search must visit to meet the share recall of the n true neighbours, by exact search for size queries."""
    chosen = queries.orderBy(F.xxhash64("id", "h")).limit(size).select("v").toArrow()
    tried = _matrix(chosen.column("v").combine_chunks())
    found = vectors.mapInArrow(_measured(forest, tried, n), "query long, down double, id long, leaves array<long>")
    place = F.row_number().over(Window.partitionBy("query").orderBy("down", "id"))
    true = found.withColumn("place", place).where(F.col("place") <= n).select("query", "leaves").collect()  # size * n rows
    wanted: list[list[set]] = [[] for _ in tried]
    for r in true:
        wanted[r.query].append(set(enumerate(r.leaves)))
    walks, missing, visited = [forest.visits(q) for q in tried], [list(w) for w in wanted], 0
    while sum(map(len, missing)) > (1 - recall) * len(true):
        for i, walk in enumerate(walks):
            leaf = next(walk, None)
            missing[i] = [w for w in missing[i] if leaf not in w]
        visited += 1
    return max(1, visited)


def _usable(vectors: DataFrame, id_: str, column: str) -> DataFrame:
    """id and v of the rows that take part: finite and not zero, of the commonest length."""
    kind = "array<float>" if vectors.schema[column].dataType.simpleString() == "array<float>" else "array<double>"
    held = vectors.select(F.col(id_).cast("long").alias("id"), F.col(column).cast(kind).alias("v")).where("id is not null and v is not null")
    finite: Callable[[Column], Column] = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    held = held.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    length = held.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return held.where(F.size("v") == (length.n if length else 0))


def nearest(vectors: DataFrame, is_query: str | Column, n: int = NEAREST, id_: str = "vec_id", column: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the n rows with the largest inner product found for each row where
    is_query holds (of the column id), nearest first, ties to the smaller id; all other rows if they are fewer.

    Equal vectors are indexed once, with their n + 1 smallest ids, which are all that can be among n results. Splits are
    fitted on SAMPLE rows; every row is indexed, in leaves of about LEAF rows whatever their number. A query visits leaves
    of all trees in the order of one priority queue. How many it takes to reach recall is measured on CALIBRATION queries
    by exact search, since it depends on the data: on vectors without any structure it is a large part of all.
    Leaves and the queries that visit them are packed into blocks in sorted ranges, so a leaf of any size, and any
    number of queries that visit it, is many small products. All vectors of the leaves are reranked exactly in double
    precision. A query that met fewer than n rows visits more leaves until it has them.
    Rows whose id or vector is null, zero or holds a null or non-finite value take no part, nor do vectors of another
    length than the commonest. Repeated rows count once. Rows that share an id but not the vector are candidates like any
    others, each a query of its own under that id. Empty table: no rows. Other columns don't matter.
    """
    spark = vectors.sparkSession
    rows = stash(_usable(vectors, id_, column).withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "v"]), "vectors")
    up_to = Window.partitionBy("v").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = rows.select("*", F.row_number().over(Window.partitionBy("v").orderBy("id")).alias("place"), F.first("id").over(up_to).alias("first")).where(F.col("place") <= n + 1)
    members = stash(places, "equal-vectors")
    alone, queries = members.where("place = 1").select("id", "h", "v"), rows.where(is_query)
    out = "query_id long, rank int, vec_id long, score double"
    size = alone.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs))), F.max(F.size("v"))).first()
    if not size[0]:
        return spark.createDataFrame([], out)
    scale = float(size[1])
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale))
    longest = math.sqrt(alone.agg(F.max(squared)).first()[0])
    depth = max(0, math.ceil(math.log2(size[0] / LEAF)))
    sample = alone.orderBy(F.xxhash64("h", "id")).limit(SAMPLE).select("v").toArrow()
    forest = fit(_matrix(sample.column("v").combine_chunks()), scale, longest, depth, TREES if depth else 1)

    kind = alone.schema["v"].dataType.simpleString()
    blocks, packed = f"tree int, leaf long, id long, h long, v {kind}", "tree int, leaf long, ids binary, hs binary, vs binary"
    index = stash(in_order(alone.mapInArrow(_indexer(forest), blocks), ["tree", "leaf"]).mapInArrow(_packer(BLOCK), packed), "forest", "zstd")
    n_leaves = len(forest.directions) << depth
    limit = calibrate(alone, queries, forest, n, recall, CALIBRATION) if depth else 1
    least = min(n + 1, rows.limit(n + 1).count())  # its own row is found too
    found, left = None, queries
    while True:
        visits = in_order(left.mapInArrow(_visitor(forest, limit), blocks), ["tree", "leaf"]).mapInArrow(_packer(QUERY_BLOCK), packed).toDF("tree", "leaf", "q_ids", "q_hs", "qs")
        met = index.join(visits, ["tree", "leaf"]).mapInArrow(_scorer("<f4" if kind == "array<float>" else "<f8", n + 1), "query_id long, qh long, down double, id long, h long")
        # n + 1 from each task that compared leaves of the query
        tops = met.groupBy("query_id", "qh").agg(F.slice(F.array_sort(F.collect_set(F.struct("down", "id", "h"))), 1, n + 1).alias("tops")).select("query_id", "qh", F.explode("tops").alias("t")).select("query_id", "qh", "t.*")
        twins = members.where("place > 1").select(F.col("first").alias("id"), "h", F.col("id").alias("twin"))
        all_ = tops.withColumn("vec_id", F.col("id")).unionByName(tops.join(twins, ["id", "h"]).withColumnRenamed("twin", "vec_id"))
        order = Window.partitionBy("query_id", "qh").orderBy("down", "vec_id")
        ranked = all_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n + 1).select("query_id", "qh", "place", "down", "vec_id", "h")
        ranked = stash(ranked, "nearest")
        whole = ranked.where(F.col("place") == least).select("query_id", "qh") if limit < n_leaves else ranked.select("query_id", "qh").distinct()
        found = ranked if found is None else found.join(left.select(F.col("id").alias("query_id"), F.col("h").alias("qh")), ["query_id", "qh"], "left_anti").unionByName(ranked)
        left = left.join(whole.select(F.col("query_id").alias("id"), F.col("qh").alias("h")), ["id", "h"], "left_anti")
        if left.isEmpty():
            break
        left, limit = stash(left, "short-queries"), min(n_leaves, 4 * limit)
    others = found.where("not (vec_id = query_id and h = qh)")
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy("down", "vec_id"))
    return others.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", (F.lit(0.0) - F.col("down")).alias("score"))


def op11_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 20 = 0")
