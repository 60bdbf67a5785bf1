import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import packing
from quern.llm.packing import QUANTUM, TEMPERATURE, Schedule, _proportions, op1_mixture_packing, pack, sequences

from .helpers import awkward, awkward_rows, empty

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check(pieces, texts, ids_of, quantum=QUANTUM):
    """Every id of every document in exactly one piece, and gapless sequences that are full but for a slot of each queue."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == {d for d, _ in texts}
    for doc in by_doc:
        want = sorted((len(i := ids_of(t)), i.tobytes()) for d, t in texts if d == doc)
        if len(want) > 1:  # rows that share an id: their pieces can't be told apart one by one
            assert sum(p.length for p in by_doc[doc]) == sum(n for n, _ in want)
            continue
        at = 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, want[0][0])
            assert p.ids_crc32 == zlib.crc32(want[0][1][4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == want[0][0]
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces_of in by_sequence.values():
        at = 0
        for p in sorted(pieces_of, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024


def test_round_trip(spark, sf_dir, ids_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = op1_mixture_packing(spark, sf_dir).collect()
    check(pieces, [(r.doc_id, r.text) for r in docs.collect()], ids_of)
    total = sum(p.length for p in pieces)
    assert total > 0.9 * 1024 * (1 + max(p.sequence_id for p in pieces))


def test_awkward_rows(spark, ids_of):
    check(pack(awkward(spark), VOCABULARY).collect(), [(r[0], r[1]) for r in awkward_rows()], ids_of)
    assert pack(empty(spark), VOCABULARY).count() == 0


def test_sequences_hold_the_ids(spark, sf_dir, ids_of):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = sequences(pack(docs, VOCABULARY, {"src0": 0.6, "src1": 0.2}, with_ids=True)).collect()
    assert max(len(r.ids) for r in whole) <= 1024
    got = np.sort(np.concatenate([r.ids for r in whole]))
    assert np.array_equal(got, np.sort(np.concatenate([ids_of(r.text) for r in docs.collect()])))


def test_schedule_is_a_permutation_and_keeps_proportions():
    rng = np.random.default_rng(1)
    for queues in (1, 2, 5, 9):
        tokens = rng.integers(1, 60_000, queues)
        schedule = Schedule(tokens, tokens.astype(float))
        slots = -(-tokens // QUANTUM)
        queue = np.repeat(np.arange(queues), slots)
        slot = np.concatenate([np.arange(n) for n in slots])
        place = schedule.place(queue, slot)
        assert np.array_equal(np.sort(place), np.arange(len(place)))
        order = queue[np.argsort(place)]
        share = tokens / tokens.sum()
        for q in range(queues):  # served so far strays from the credit by a slot or so, at any window
            served = np.cumsum(order == q)
            assert np.abs(served - share[q] * np.arange(1, len(order) + 1)).max() <= 2 + queues / 2


def test_weights_hold_until_a_queue_is_empty():
    schedule = Schedule(np.array([256 * 400, 256 * 400]), np.array([3.0, 1.0]))
    queue = np.repeat([0, 1], 400)
    order = queue[np.argsort(schedule.place(queue, np.tile(np.arange(400), 2)))]
    for window in range(100):
        assert abs(int((order[: 4 * (window + 1)] == 0).sum()) - 3 * (window + 1)) <= 1


def test_target_proportions_hold_in_the_first_windows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, VOCABULARY, {"src0": 0.25, "src1": 0.25}).join(docs.select("doc_id", "source"), "doc_id")
    total = {r.source: r.n for r in pieces.groupBy("source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    windows = int(min(total["src0"], total["src1"]) / 256)  # until the first of the two is empty
    first = pieces.where(f"sequence_id < {windows}").groupBy("source").sum("length").collect()
    share = {r.source: r[1] / (1024 * windows) for r in first}
    assert abs(share["src0"] - 0.25) < 0.75 / windows and abs(share["src1"] - 0.25) < 0.75 / windows


def test_query_keeps_its_mixture_in_each_window(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = op1_mixture_packing(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    total = pieces.groupby("source").length.sum()
    target = total**TEMPERATURE / (total**TEMPERATURE).sum()
    assert (target - total / total.sum()).abs().max() > 0.002  # another mixture than the corpus' own
    windows = int((total / target).min() / 1024)  # until the first source is out
    assert windows > 20
    served = pieces.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum").reindex(range(windows)).fillna(0).cumsum()
    for source in total.index:
        owed = target[source] * 1024 * (served.index + 1) - served[source]
        assert owed.abs().max() <= QUANTUM * (2 + len(total) / 2)


def test_deficits_are_carried_from_window_to_window():
    tokens = np.array([40_000, 9_000, 25_000, 3_000])
    schedule = Schedule(tokens, _proportions(tokens, [None] * 4, {}, 0.7))
    for windows in range(1, 40):
        assert abs(schedule.deficits(windows).sum()) < 1e-6 and np.abs(schedule.deficits(windows)).max() <= 2 * QUANTUM


def test_rare_sources_have_queues_by_weight_and_by_bytes(spark, ids_of, monkeypatch):
    monkeypatch.setattr(packing, "MAX_NAMED", 256)
    # rare: 4 of 1606 rows and little text; long: 2 rows with about half of the text; both under 1 / 256 of the rows
    rows = [(i, "some words of common text " * 12, f"s{i % 400}") for i in range(1600)]
    rows += [(2000 + i, "rare words " * 256, "rare") for i in range(4)] + [(3000 + i, "long words " * 24_000, "long") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)

    def shares(weights, source, windows):
        pieces = pack(docs, VOCABULARY, weights).join(docs.select("doc_id", "source"), "doc_id").collect()
        check(pieces, [(d, t) for d, t, _ in rows], ids_of)
        return sum(p.length for p in pieces if p.source == source and p.sequence_id < windows) / (1024 * windows)

    assert abs(shares({"rare": 0.5}, "rare", 4) - 0.5) <= 0.125
    total = {s: sum(len(ids_of(t)) for _, t, x in rows if (x == "long") == (s == "long")) for s in ("long", "rest")}
    for windows in (40, 80):
        assert abs(shares(None, "long", windows) - total["long"] / sum(total.values())) < 0.1
    with pytest.raises(ValueError):
        pack(docs, VOCABULARY, {"absent": 0.5})
    assert pack(empty(spark), VOCABULARY, {"absent": 0.5}).count() == 0


def test_weights_are_proportions(spark):
    assert np.allclose(_proportions(np.array([10, 30, 60]), ["a", "b", None], {"a": 0.5}), [0.5, 1 / 6, 1 / 3])
    for wrong in ({"a": 0.7, "b": 0.4}, {"a": 0.0}):
        with pytest.raises(ValueError):
            _proportions(np.array([1, 1]), ["a", "b"], wrong)


def test_window_must_hold_whole_slots(spark):
    with pytest.raises(ValueError):
        pack(empty(spark), VOCABULARY, window=1000, quantum=300)
