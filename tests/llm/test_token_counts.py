import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quern.llm import encoding
from quern.llm.token_counts import count_tokens, op3_token_counts

from .helpers import awkward, awkward_rows, empty, rows_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_awkward_rows(spark, library):
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in awkward_rows()]
    assert rows_of(count_tokens(awkward(spark), VOCABULARY), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert count_tokens(empty(spark), VOCABULARY).count() == 0


def test_query_equals_library(spark, sf_dir, library):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) for r in texts}
    assert {r.doc_id: r.n_tokens for r in op3_token_counts(spark, sf_dir).collect()} == want


def test_every_code_point(library):
    ours = encoding.encoder(VOCABULARY)
    assert isinstance(ours, encoding.ByteLevel)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0)]
    texts = [f"a!{chr(c)}b c{chr(c)} {chr(c)}d {chr(c)}{chr(c)} 's" for c in points]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ours.encode(text).tolist() == want.ids
        assert [i for part in encoding.slices(text, 1) for i in ours.encode(part).tolist()] == want.ids


def test_long_and_special_texts(library):
    ours = encoding.encoder(VOCABULARY)
    texts = ["word <|endoftext|> " * 9000, "z" * 100_000, " " * 70_000, "é" * 70_000, "a\n\n \t b" * 12_000, "<|endoftext|>" * 3]
    for text in texts:
        assert ours.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert "".join(encoding.slices(texts[0], 1000)) == texts[0]


def test_other_files(spark):
    for name in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        one = encoding.encoder(public_tokenizers.path(name))
        texts = ["A cat sat.", "", "naïve Über 日本"]
        assert one.lengths(texts) == [len(one.ids(t)) for t in texts]
