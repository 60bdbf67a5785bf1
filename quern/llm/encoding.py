"""Tokenizer files of three libraries behind one interface: lengths or ids of whole texts."""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Unicode's White_Space, which the pre-tokenizer of the byte-level files calls \s (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: White space after something else. No token of a byte-level file reaches over such a place, and what
#: stands before it is encoded without looking further, so a text may be cut there without any change.
SAFE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: Characters of a text that are encoded in one call.
SLICE = 1 << 16
_SELF_TEST = ["", " a  b\n\n c", "don't we'll 'S", "<|endoftext|>x <|endoftext|>", "12abé中‍ !?\t\r\n ", "x" * 300, "  q"]


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about size characters, cut at safe places alone; one part where there is none."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Without begin, end or added special tokens; special strings as the library has them by default."""

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text."""
        raise NotImplementedError

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(self.ids(t)) for t in texts]

    def plain_ids(self, text: str) -> np.ndarray:
        """uint32 ids of the whole text, in which special strings are text like any other."""
        raise NotImplementedError

    def token_bytes(self) -> list[bytes]:
        """By id, the bytes that a token stands for."""
        raise NotImplementedError


class Ranks(Encoder):
    """A tiktoken rank file with the pattern of the byte-level files; it has no special tokens."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self._build({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, {})

    def _build(self, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        import public_tokenizers
        import tiktoken

        encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special).encode_to_numpy
        self.encode = functools.partial(encode, allowed_special="all", disallowed_special=())
        self.encode_plain = functools.partial(encode, allowed_special=set(), disallowed_special=())
        self.ranks = ranks

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= SLICE:
            return self.encode(text)
        return np.concatenate([self.encode(part) for part in slices(text)])

    def plain_ids(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode_plain(part) for part in slices(text)])

    def token_bytes(self) -> list[bytes]:
        found = [b""] * (1 + max(self.ranks.values()))
        for token, i in self.ranks.items():
            found[i] = token
        return found

    def lengths(self, texts: list[str]) -> list[int]:
        encode = self.encode
        return [len(encode(t)) if len(t) <= SLICE else sum(len(encode(part)) for part in slices(t)) for t in texts]


class TokenizersFile(Encoder):
    """A tokenizers file, by its library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class ByteLevel(Ranks):
    """A byte-level tokenizers file whose ids are its merge ranks, run by the faster merge loop of tiktoken.

    The tokenizers library does 2 MB a second and core on such text, this does 8. The two give the same ids:
    a short self-test on loading compares them, and the tests do over every code point.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        # byte-level files write byte b as chr(b) where that is printable, else as the next free character from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(printable)]
        to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        vocab = file["model"]["vocab"]
        self._build({bytes(to_byte[c] for c in token): i for token, i in vocab.items() if token not in special}, special)
        library = TokenizersFile(path)
        if any(not np.array_equal(self.ids(t), library.ids(t)) for t in _SELF_TEST):
            raise ValueError(f"{path}: ids differ from the library's")


class Pieces(Encoder):
    """A sentencepiece model, over whole texts: it prefixes and trims each text, so parts would differ."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))

    def plain_ids(self, text: str) -> np.ndarray:
        return self.ids(text)  # the model has no special strings

    def token_bytes(self) -> list[bytes]:
        piece, is_byte = self.model.id_to_piece, self.model.is_byte
        return [bytes([int(piece(i)[3:5], 16)]) if is_byte(i) else piece(i).replace("\u2581", " ").encode() for i in range(self.model.vocab_size())]


def _tokenizers(path: str) -> Encoder:
    try:
        return ByteLevel(path)
    except (KeyError, ValueError):  # another kind of model: its library encodes whole texts
        return TokenizersFile(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file; a Python worker loads each file once."""
    return {".json": _tokenizers, ".model": Pieces, ".tiktoken": Ranks}[os.path.splitext(path)[1]](path)
