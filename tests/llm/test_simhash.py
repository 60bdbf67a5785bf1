import re

import numpy as np
import xxhash

from quern.llm.simhash import BITS, _above, close_pairs, components, drawn_bits, fingerprint, keep_one, links, near_duplicates, op7_bit_sliced_simhash, wide_fingerprint, wide_links

from .helpers import awkward, awkward_rows, empty, rows_of


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """prints: (id, fingerprint); the least id of each row's component, None counting last."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def near_prints(n, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
    near = base.copy()
    for k in (2, 3, 5):
        near[::k] ^= np.uint64(1) << rng.integers(0, BITS, len(near[::k])).astype(np.uint64)
    return np.unique(np.concatenate((base, near)))


def test_bit_sliced_pairs_equal_brute_force():
    prints = near_prints(300)
    n = len(prints)
    rng = np.random.default_rng(1)
    for low, high in ((np.arange(n) + 1, np.full(n, n)), (rng.integers(0, n, n), rng.integers(0, n + 1, n))):
        for radius in (0, 1, 2, 3, 5):
            got = set(zip(*(x.tolist() for x in close_pairs(prints, low, high, radius)), strict=True))
            want = {(i, j) for i in range(n) for j in range(low[i], high[i]) if int(prints[i] ^ prints[j]).bit_count() <= radius}
            assert got == want
    assert [x.tolist() for x in close_pairs(prints[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))] == [[], []]


def test_comparison_of_counters():
    values = np.arange(8)
    counter = np.stack([np.array([sum(int(v >> k & 1) << int(v) for v in values)], np.uint64) for k in range(3)])
    for radius in range(4, 8):
        assert int(_above(counter, radius)[0]) & 0xFF == sum(1 << int(v) for v in values if v > radius)


def test_links_with_tiny_tiles_lose_nothing(spark):
    prints = near_prints(60, 3)
    # a bucket of hundreds: all agree on the upper 48 bits
    crowd = (np.uint64(0xABCDEF0123450000) + np.arange(0, 300, 7, dtype=np.uint64))
    every = np.unique(np.concatenate((prints, crowd)))
    frame = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    for tile in (5, 2048):
        stars = {r.node: r.root for r in components(links(frame, tile)).collect()}
        got = [stars.get(int(x), int(x)) for x in every.view(np.int64)]
        want = brute_components([(int(x), int(x) & (1 << 64) - 1) for x in every.view(np.int64)])
        assert got == want


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(chain).collect()}
    assert roots == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_awkward_rows(spark):
    rows = [(r[0], brute_print(r[1])) for r in awkward_rows()]
    want = sorted(((d, p - (1 << 64) if p >> 63 else p, c) for (d, p), c in zip(rows, brute_components(rows), strict=True)), key=repr)
    assert rows_of(near_duplicates(awkward(spark)), "doc_id", "fp", "component_id") == want
    assert near_duplicates(empty(spark)).count() == 0 and keep_one(empty(spark)).count() == 0


def brute_wide(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    out = 0
    for half, seed in enumerate((42, 43)):
        hashes = [int.from_bytes(xxhash.xxh3_128_digest(s.encode(), seed), "little") for s in found]
        out |= sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << (128 * half)
    return out


def brute_groups(rows, similar=True):
    """rows: (doc_id, text); a number for each row's group."""
    if similar:
        prints = [brute_wide(r[1]) for r in rows]
        tables = [sum(1 << int(b) for b in bits) for bits in drawn_bits(len(set(prints)))]
        linked = lambda a, b: a == b or ((a ^ b).bit_count() <= 48 and any(not (a ^ b) & t for t in tables))
    else:
        prints = [brute_print(r[1]) for r in rows]
        linked = lambda a, b: (a ^ b).bit_count() <= 2
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and linked(prints[i], prints[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    return root


def brute_keep(rows, similar=True):
    """rows: (doc_id, text). The rows of each group."""
    root = brute_groups(rows, similar)
    return [[rows[i] for i in range(len(rows)) if root[i] == r] for r in set(root)]


def check_keep(kept, rows, similar=True):
    """One row a component, and one with the component's least id."""
    kept = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    groups = brute_keep([(r[0], r[1]) for r in rows], similar)
    assert len(kept) == len(groups)
    for group in groups:
        ids = [d for d, _ in group if d is not None]
        least = [x for x in group if x[0] == (min(ids) if ids else None)]
        assert sum(1 for k in kept if k in least) >= 1
    assert all(sum(k in g for g in groups) >= 1 for k in kept)


def test_one_row_of_each_component_stays(spark):
    for similar in (True, False):
        kept = keep_one(awkward(spark), similar)
        assert kept.columns == awkward(spark).columns
        check_keep(kept, awkward_rows(), similar)
    a, b = "one two three four five six seven", "quite another text with other words in it"
    for rows in ([(1, a), (None, a), (None, b)], [(1, a), (3, a), (3, b)], [(1, a), (1, a), (2, a)], [(None, a), (None, a)], [(5, None), (4, ""), (4, "")]):
        for similar in (True, False):
            check_keep(keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), similar), rows, similar)
    ids = spark.createDataFrame([("x", a), ("b", a), (None, a), ("y", b)], "doc_id string, text string")
    assert rows_of(keep_one(ids), "doc_id") == [("b",), ("y",)]


def test_near_copies_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows, copies = [], 0
    for i in range(120):
        text = rng.choice(words, int(rng.integers(30, 400))).tolist()
        rows.append((i, " ".join(text)))
        for k in range(int(rng.integers(0, 4)) if i % 3 == 0 else 0):  # a copy with one word in a hundred replaced, so that 0.9 of the shingles stay
            at = rng.choice(len(text), max(1, len(text) // 100), replace=False)
            rows.append((1000 + 10 * i + k, " ".join("changed" if j in at else w.upper() for j, w in enumerate(text))))
            copies += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in keep_one(docs).select("doc_id").collect()}
    assert copies > 40 and set(range(120)) <= kept
    sets = {d: {tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    alike = {d for d, _ in rows if d >= 1000 and len(sets[d] & sets[(d - 1000) // 10]) >= 0.85 * len(sets[d] | sets[(d - 1000) // 10])}
    assert len(alike) > 30 and len(alike & kept) <= 0.02 * len(alike)
    assert wide_fingerprint(b"") == wide_fingerprint(b" \n ") == bytes(32) and int.from_bytes(wide_fingerprint("Über x a b C d".encode()), "little") == brute_wide("Über x a b C d")


def test_wide_comparison_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 256, (60, 32), np.uint8)
    every = [base]
    for flips in (0, 10, 30, 47, 48, 49, 60):
        near = base.copy()
        for row in near:
            for b in rng.choice(256, flips, replace=False):
                row[b // 8] ^= 1 << (b % 8)
        every.append(near)
    prints = np.concatenate(every)
    words = prints.view("<u8")
    n = len(words)
    got = set(zip(*(x.tolist() for x in close_pairs(words, np.arange(n) + 1, np.full(n, n), 48)), strict=True))
    bits = np.unpackbits(prints, axis=1).astype(int)
    distance = bits @ (1 - bits.T) + (1 - bits) @ bits.T
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if distance[i, j] <= 48}
    # with tiny tiles: what shares a bucket and is near is connected, and nothing else
    ids = {bytes(p): i for i, p in enumerate(prints)}
    frame = spark.createDataFrame([(bytearray(p),) for p in ids], "fp binary")
    tables = drawn_bits(len(ids))
    both = np.unpackbits(prints, axis=1, bitorder="little")
    for tile in (3, 2048):
        stars = {bytes(r.node): bytes(r.root) for r in components(wide_links(frame, tile)).collect()}
        root = {p: p for p in ids}
        for i, j in got:
            if bytes(prints[i]) != bytes(prints[j]) and (both[i][tables] == both[j][tables]).all(1).any():
                a, b = root[bytes(prints[i])], root[bytes(prints[j])]
                root = {p: min(a, b) if r in (a, b) else r for p, r in root.items()}
        assert {p: stars.get(p, p) for p in ids} == root and len(stars) > 60


def test_rows_that_go_are_the_only_ones_shuffled(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in plan and rows_of(keep_one(docs), *docs.columns) == rows_of(keep_one(docs.repartition(3)), *docs.columns)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [(d, brute_print(t)) for d, t in docs]
    want = sorted((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True))
    assert rows_of(op7_bit_sliced_simhash(spark, sf_dir), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert fingerprint(b"") == 0
