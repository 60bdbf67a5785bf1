"""Mixture-controlled packing: deficit round-robin over source queues, in closed form for any slot of any queue."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import byte_blocks, stash, table
from .encoding import encoder

WINDOW, QUANTUM, END = 1024, 256, 0
#: Sources without a weight share by their tokens to this power: below 1, small sources come oftener than their size says.
TEMPERATURE = 0.7
#: Sources with 1 / MAX_NAMED of the rows or of the bytes of text have a queue each, so there are twice MAX_NAMED at most, and
#: so have sources with a weight; others share SHARED queues by hash.
MAX_NAMED, SHARED = 1024, 64
BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Schedule:
    """Deficit round-robin over queues of tokens that are served by slots of `quantum` tokens.

    Round by round, queue s is credited with weight[s] slots, and its slot j is served as its credit
    passes j + 1/2. What it has been served thus never strays from its credit by more than half a slot,
    and the difference, its deficit, is carried from window to window. An empty queue is passed over.
    The order of service is that of (j + 1/2) / weight[s], ties by s, so the place of a slot is the count
    of slots before it in each queue: any task can tell it for its own slots, without the others' deficits.
    """

    tokens: np.ndarray
    weights: np.ndarray
    window: int = WINDOW
    quantum: int = QUANTUM

    def _due(self, queue: np.ndarray | int, slot: np.ndarray) -> np.ndarray:
        return (2.0 * slot + 1.0) / self.weights[queue]

    def place(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The place in the order of service, from 0 without gaps, of each (queue, slot)."""
        due = self._due(queue, slot)
        before = np.zeros(len(slot), np.int64)
        for q in range(len(self.tokens)):
            last = -(-int(self.tokens[q]) // self.quantum)
            # slots of q that are due earlier: an estimate, then exact comparisons of the same numbers
            n = np.clip(np.floor((due * self.weights[q] - 1.0) / 2.0).astype(np.int64) - 1, 0, last)
            while (more := (n < last) & self._earlier(q, n, due, queue)).any():
                n = n + more
            while (less := (n > 0) & ~self._earlier(q, n - 1, due, queue)).any():
                n = n - less
            before += n
        return before

    def _earlier(self, q: int, slot: np.ndarray, due: np.ndarray, queue: np.ndarray) -> np.ndarray:
        own = self._due(q, slot)
        return (own < due) | ((own == due) & (q < queue))

    def deficits(self, windows: int) -> np.ndarray:
        """The tokens that each queue is owed after so many windows: its credit less what it was served.

        While no queue is empty it is a slot at most, either way; it is what the next window, in whatever task, begins with.
        """
        every = np.concatenate([np.full(-(-int(n) // self.quantum), q) for q, n in enumerate(self.tokens)])
        slot = np.concatenate([np.arange(-(-int(n) // self.quantum)) for n in self.tokens])
        served = np.bincount(every[self.place(every, slot) < windows * (self.window // self.quantum)], minlength=len(self.tokens))
        return (self.weights / self.weights.sum() * windows * self.window) - served * self.quantum

    def spots(self, queue: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset there) of each slot. Only a queue's last slot may be short, and leaves no gap."""
        per = self.window // self.quantum
        short = np.flatnonzero(self.tokens % self.quantum)
        at = self.place(short, self.tokens[short] // self.quantum)
        by = np.argsort(at)
        missing = np.concatenate(([0], np.cumsum(self.quantum - self.tokens[short][by] % self.quantum)))
        lost_before = lambda x: missing[np.searchsorted(at[by], x)]
        place = self.place(queue, slot)
        sequence = place // per
        return sequence, place % per * self.quantum - (lost_before(place) - lost_before(sequence * per))


def _encoder(path: str, named: dict[str | None, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, totals = encoder(path), TaskContext.get().partitionId(), {}
        for block in byte_blocks(batches, "text", BLOCK_BYTES):
            queues, before, sizes, ids = [], [], [], []
            for text, source in zip(block.column("text").to_pylist(), block.column("source").to_pylist(), strict=True):
                queue = named.get(source, -1)
                if queue < 0:
                    queue = len(named) + zlib.crc32((source or "").encode()) % SHARED
                found = np.append(tokens.ids(text), np.uint32(END)).astype("<u4")
                queues.append(queue)
                before.append(at := totals.get(queue, 0))
                sizes.append(len(found))
                totals[queue] = at + len(found)
                ids.append((found.astype("<u2") if found.max() < 1 << 16 else found).tobytes())
            columns = [pa.array(queues, pa.int32()), pa.array([part] * len(queues), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], names=["doc_id", "queue", "part", "before", "size", "ids"])

    return encode


def _cutter(schedule: Schedule, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue, first, size = (batch.column(c).to_numpy().astype(np.int64) for c in ("queue", "first", "size"))
            slots = (first + size - 1) // schedule.quantum - first // schedule.quantum + 1
            row = np.repeat(np.arange(len(size)), slots)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(slots) - slots, slots) + first[row] // schedule.quantum
            start = np.maximum(slot * schedule.quantum, first[row])
            end = np.minimum((slot + 1) * schedule.quantum, (first + size)[row])
            sequence, offset = schedule.spots(queue[row], slot)
            offset = offset + start - slot * schedule.quantum
            start, length = start - first[row], end - start
            crcs, kept, last, view = [], [], -1, b""
            for r, a, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if r != last:
                    raw, last = batch.column("ids")[r].as_py(), r
                    view = raw if len(raw) == 4 * size[r] else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                piece = view[4 * a : 4 * (a + n)]
                crcs.append(zlib.crc32(piece))
                if with_ids:
                    kept.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = [pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(size[row]), pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *columns], names=names)

    return cut


def _named_sources(docs: DataFrame, weights: Mapping[str, float]) -> dict[str | None, int]:
    """Sources with at least 1 / MAX_NAMED of the rows or of the bytes, and those in weights, numbered in the order of their names."""
    counts = stash(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")), "sources")
    n, size = counts.agg(F.sum("n"), F.sum("size")).first()
    if not n:
        return {}
    large = (F.col("n") * MAX_NAMED >= n) | ((F.col("size") > 0) & (F.col("size") * MAX_NAMED >= size))
    found = [r["source"] for r in counts.where(large | F.col("source").isin([*weights])).select("source").collect()]
    if absent := sorted(set(weights) - set(found)):
        raise ValueError(f"weights of sources that no document has: {absent}")
    return {s: i for i, s in enumerate(sorted(found, key=lambda s: (s is not None, s)))}


def _proportions(sizes: np.ndarray, sources: list[str | None], weights: Mapping[str, float], temperature: float = 1.0) -> np.ndarray:
    """The queues' target proportions: those asked for, and the rest by tokens, a trifle where nothing is left."""
    if sum(weights.values()) > 1.0 + 1e-9 or min(weights.values(), default=1.0) <= 0.0:
        raise ValueError("weights must be above 0 and 1 at most together")
    asked = np.array([weights.get(s, np.nan) if s is not None else np.nan for s in sources], np.float64)
    left = np.isnan(asked)
    rest = max(1e-6, 1.0 - float(np.nansum(asked)))
    by = sizes.astype(np.float64) ** temperature
    return np.where(left, rest * by / max(1.0, by[left].sum()), asked)


def pack(
    docs: DataFrame, vocabulary: str, weights: Mapping[str, float] | None = None, temperature: float = 1.0, window: int = WINDOW, quantum: int = QUANTUM, with_ids: bool = False
) -> DataFrame:
    """Cut the documents into pieces that fill sequences of window tokens in the proportions of the sources.

    Each source is a queue: its documents' ids, id END after each, one after another. weights are target
    proportions of sources, at most 1 together; sources that they leave out share the rest by their numbers of tokens to
    the power of temperature. At 1 all queues last to the end; below, small sources come oftener and run out first, and what
    is left goes on by the same proportions. A source with a weight has a queue of its own, however small it is; one that
    no document has is an error. Each sequence holds window / quantum slots, each of one queue.

    Two passes and no shuffle of text or ids: the first encodes, notes each document's place in its task's part
    of the queue and writes ids and places to the shared folder; counts by (queue, task) give the parts'
    places; the second cuts, and computes each slot's sequence and offset from the Schedule. Only the queues' totals,
    2 * MAX_NAMED + SHARED numbers and one a weight at most, come to the driver.

    Each id lies in one piece; sequences are full but for the last slot of each queue. The order within a queue
    is that of the input's files. Null text: no ids but END. Null source: a source of its own. Equal rows
    are packed each; an empty table gives no rows; a null doc_id passes through; other columns don't matter.
    """
    if window % quantum:
        raise ValueError("window must be a multiple of quantum")
    held = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    named = _named_sources(held.select("source", "text"), weights or {})
    tokens = stash(held.mapInArrow(_encoder(vocabulary, named), f"doc_id {kind}, queue int, part int, before long, size long, ids binary"), "tokens", codec="zstd")
    parts = stash(tokens.groupBy("queue", "part").agg(F.sum("size").alias("size")), "parts")
    totals = {r["queue"]: r["size"] for r in parts.groupBy("queue").agg(F.sum("size").alias("size")).collect()}
    queues = sorted(totals)
    by_queue = {q: s for s, q in named.items()}
    sizes = np.array([totals[q] for q in queues], np.int64)
    schedule = Schedule(sizes, _proportions(sizes, [by_queue.get(q) for q in queues], weights or {}, temperature), window, quantum)
    up_to = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stash(parts.select("queue", "part", F.coalesce(F.sum("size").over(up_to), F.lit(0)).alias("base")), "bases")
    numbers = F.array_position(F.array(*[F.lit(q) for q in queues] or [F.lit(0)]), F.col("queue")) - 1
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", numbers.alias("queue"), (F.col("base") + F.col("before")).alias("first"), "size", "ids")
    return placed.mapInArrow(_cutter(schedule, with_ids), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) from pieces with ids; a sequence is at most one window, so no group grows."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), temperature=TEMPERATURE)
