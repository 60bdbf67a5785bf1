import base64
import random
import re
from collections import Counter

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import quality
from quern.llm.quality import filter_quality, measure, op9_compression_bands, score

from .helpers import awkward, awkward_rows, empty, rows_of


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside), failed


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é\n\t#*|\x85\xa0\x1c", max_size=150))
def test_measures(text):
    assert measure(text.encode(), zstandard.ZstdCompressor(level=3))[:6] == brute(text)


def test_awkward_rows(spark):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(score(awkward(spark)), *columns) == sorted(((r[0], *brute(r[1])) for r in awkward_rows()), key=repr)
    assert score(empty(spark)).count() == 0
    kept = filter_quality(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == score(awkward(spark)).where("kept").count()


def brute_kept(text):
    """The verdict on its own: whole text, then pieces of 4096 bytes, each against the band of its length."""
    data = (text or "").encode()
    if brute(text)[5]:
        return False

    def fits(piece):
        low, high = next((b.low, b.high) for b in reversed(quality.WHOLE_BANDS) if len(piece) >= b.min_bytes)
        return low <= len(zstandard.ZstdCompressor(level=3).compress(piece)) / len(piece) <= high

    pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) >= 4096 else []
    if len(pieces) > 1 and len(pieces[-1]) < 256:
        pieces[-2:] = [pieces[-2] + pieces[-1]]
    bad = sum(len(p) for p in pieces if not fits(p))
    return fits(data) and bad < 8192 and bad * 4 < len(data)


def test_verdicts_equal_brute_force(spark, sf_dir):
    want = {r.doc_id: brute_kept(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.kept for r in op9_compression_bands(spark, sf_dir).collect()} == want and len(set(want.values())) == 2
    rng = random.Random(3)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i % 53}" for i in range(400)]
    texts = []
    for size in (60, 150, 300, 1000, 4096, 4300, 9000, 30_000, 90_000):
        clean = ""
        while len(clean) < size:
            clean += rng.choice(words) + (". " if rng.random() < 0.1 else " ")
        clean = clean[:size]
        for bad in (0, size // 8, size // 3, size):
            texts += [clean[: size - bad] + noise(bad).decode(), clean[: size - bad] + "again and again " * (bad // 16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.kept for r in sorted(score(docs).collect())]
    assert got == [brute_kept(t) for t in texts] and 10 < sum(got) < len(got) - 10


def test_bands_reject_repetition_and_noise():
    zstd = zstandard.ZstdCompressor(level=3)
    prose = " ".join(f"w{i * 7919 % 613} and {i * 104729 % 911}" for i in range(900)).encode()
    noise = "".join(chr(33 + (i * i * 7919 + i * 104729 + (i << 7) % 1013) % 90) + (" " if i % 9 == 0 else "") for i in range(6000)).encode()
    assert measure(prose, zstd)[9]
    assert not measure(b"spam and eggs " * 400, zstd)[9]
    assert not measure(bytes(b"".join(bytes([65 + (i * i) % 23, 32 if i % 6 == 0 else 97]) for i in range(300))) * 30, zstd)[9]
    assert measure(noise, zstd)[6] > measure(prose, zstd)[6]
    # half of the chunks bad is too much, whatever the whole text says
    mixed = prose[: quality.CHUNK] + b"tail " * (quality.CHUNK // 5 + 1) * 2
    assert measure(mixed, zstd)[7:9] == (3, 2) and not measure(mixed, zstd)[9]


def noise(size, seed=0):
    """Words of random base64, twenty at least, so that the base rules pass."""
    rng = random.Random(seed)
    longest = min(12, size // 22)
    words = []
    while sum(map(len, words)) + len(words) < size:
        words.append(base64.b64encode(rng.randbytes(12)).decode()[: rng.randint(longest // 2, longest)])
    return " ".join(words)[:size].encode()


def test_noise_of_each_length_is_rejected():
    zstd = zstandard.ZstdCompressor(level=3)
    starts = [b.min_bytes for b in quality.WHOLE_BANDS]
    sizes = {n for a, b in zip(starts, [*starts[1:], 60_000], strict=True) for n in (max(a, 90), (a + b) // 2, b - 1) if n >= 90}
    for size in sorted(sizes | {494, 989, 1990, 3992, 7996}):
        for seed in range(5):
            row = measure(noise(size, seed), zstd)
            assert not row[5] and not row[9], (size, row)
    assert all(b.low > 0 and b.high < 1 for b in quality.WHOLE_BANDS)


def test_noise_does_not_hide_in_clean_text(spark):
    zstd = zstandard.ZstdCompressor(level=3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    clean = " ".join(r.text for r in docs.where("n_chars > 500").dropDuplicates(["text"]).orderBy("doc_id").limit(200).collect()).encode()
    assert len(clean) > 160_000 and measure(clean[:160_000], zstd)[9]
    for size, bad in ((8191, 4095), (40_960, 18_000), (160_000, 70_000), (160_000, 20_000), (20_000, 8_000), (9_000, 4_000)):
        for at in (0, (size - bad) // 2, size - bad):
            text = clean[:at] + noise(bad) + clean[at : size - bad]
            row = measure(text, zstd)
            assert not row[5] and not row[9], (size, bad, at, row)


def test_chunks_hold_every_byte():
    for size in (0, 4095, 4096, 4351, 4352, 8191, 8192, 8200, 20_000):
        found = quality.chunks(bytes(i % 251 for i in range(size)))
        assert b"".join(found) == (bytes(i % 251 for i in range(size)) if size >= 4096 else b"")
        assert all(256 <= len(c) < 4096 + 256 for c in found)


def test_clean_documents_stay(spark, sf_dir):
    rows = op9_compression_bands(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert rows.count() == rows.where("kept").count() > 20
