import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import token_alignment
from quern.llm.encoding import encoder
from quern.llm.token_alignment import Chunk, align_tokens, op13_token_alignment, pack, unpack

from .helpers import SCHEMA, awkward, awkward_rows, empty, rows_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def sides():
    """Each library's own ids and, by another way than the operator's, their bytes."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in printable}
    for i, b in enumerate(b for b in range(256) if b not in printable):
        chars[chr(256 + i)] = b

    def first(text):
        return [(i, bytes(chars[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]

    def second(text):
        return [(i, bytes([int(two.id_to_piece(i)[3:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode()) for i in two.encode(text)]

    return first, second


def brute(docs, sides):
    links, rows = [], []
    for d, t, *_ in docs:
        a, b = ([], []) if not t else (f(t) for f in sides)
        if b"".join(x for _, x in a) != b"".join(x for _, x in b) or b"".join(x for _, x in a) != b" " + (t or "").encode():
            a, b = [], []
        spans = []
        for side in (a, b):
            at, spans_of = 0, []
            for i, x in side:
                spans_of.append((i, at, at := at + len(x)))
            spans.append(spans_of)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        sides_of = []
        for side in spans:
            by_cut = defaultdict(list)
            for i, _, e in side:
                by_cut[bisect.bisect_left(cuts, e)].append(str(i))
            sides_of.append(by_cut)
        groups = [[",".join(s[k]) for s in sides_of] for k in range(len(cuts))]
        found, k = Counter(), 0
        for i, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][1] < e:
                found[i, spans[1][j][0]] += 1
                j += 1
        links.append(found)
        sha = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if a else ""
        rows.append([d, len(a), len(b), len(groups), sum(found.values()), 0, 0, sha])
    docs_with = Counter(p for found in links for p in found)
    best = defaultdict(int)
    for (a, _), n in docs_with.items():
        best[a] = max(best[a], n)
    for row, found in zip(rows, links, strict=True):
        row[5] = sum(n for p, n in found.items() if docs_with[p] == best[p[0]])
        row[6] = sum(n * docs_with[p] for p, n in found.items())
    return sorted(map(tuple, rows), key=repr)


ODD = [(700 + i, t, None, "s", 1) for i, t in enumerate(["▁marked", "<|endoftext|> and <s> </s> <unk> <0x41>", " ", "  two  spaces ", "\x00\x01", "🤖🤖é́ ﬁ", "日本語　テキスト", "a", "\n\n\t", "­soft‍joined", "٣٤", "word " * 30])]


def test_awkward_rows(spark, sides):
    docs = awkward_rows() + ODD
    frame = spark.createDataFrame(docs, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("chunk", "kind", "links", "n", "n_a", "pair")]).repartition(3)
    assert rows_of(align_tokens(frame, A, B), *COLUMNS) == brute(docs, sides)
    assert align_tokens(empty(spark), A, B).count() == 0
    assert rows_of(align_tokens(awkward(spark).where("text is null"), A, B), *COLUMNS) == brute([r for r in awkward_rows() if r[1] is None], sides)


def test_query_equals_brute_force(spark, sf_dir, sides):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op13_token_alignment(spark, sf_dir), *COLUMNS) == brute(docs, sides)


def test_parts_and_chunks_change_nothing(spark, sides, monkeypatch):
    """Texts longer than a block come in parts; with small blocks every text does."""
    docs = awkward_rows() + ODD
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 64)
    chunk = Chunk(A, B)
    for d in docs:
        chunk.add(d[1])
    stats, links, pairs, held = chunk.rows()
    want = brute([(i, *d[1:]) for i, d in enumerate(docs)], sides)
    by_doc = {r[0]: r for r in want}
    totals = dict(zip(pairs.tolist(), held.tolist(), strict=True))
    for i, (s, packed, h) in enumerate(zip(stats, links, chunk.hashes, strict=True)):
        of, times = unpack(packed)
        assert tuple(s) == by_doc[i][1:5] and (h.hexdigest() if h else "") == by_doc[i][7]
        assert sum(totals[p] * n for p, n in zip(pairs[of].tolist(), times.tolist(), strict=True)) == by_doc[i][6]
        assert (np.diff(of) > 0).all()


def test_packing_round_trip():
    for number, times in (([], []), ([0], [1]), ([3, 4, 70000, 2**31], [1, 300, 2, 70000])):
        got = unpack(pack(np.array(number, np.int64), np.array(times, np.int64)))
        assert got[0].tolist() == number and got[1].tolist() == times


def test_special_strings_are_plain_text():
    one = encoder(A)
    assert 50256 in one.ids("a<|endoftext|>b") and 50256 not in one.plain_ids("a<|endoftext|>b")
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    for text in ("a<|endoftext|>b", " <|endoftext|>" * 20_000, "x y\n" * 40_000):
        assert one.plain_ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
