"""Byte-level BPE ids of whole texts by the tokenizers library, with a cache of space-led chunks."""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: White space that isn't one space before a word: what is on either side of such a space isn't encoded apart.
_JOINED = re.compile(r"\s (?=\s|\Z)")
#: Fixed value: the split of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies have for each byte: printable ones for themselves, the others from 256 on."""
    out, more = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(more)] = b
            more += 1
    return out


def _ranks(path: str, t: Tokenizer) -> dict[bytes, int] | None:
    """Tokens by id, if the file is a byte-level BPE whose merges stand in the order of their ids."""
    told = json.loads(t.to_str())
    pre, merges = told.get("pre_tokenizer") or {}, told["model"].get("merges") or []
    if told["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or told.get("normalizer"):
        return None
    vocab, special = told["model"]["vocab"], {x["content"] for x in told["added_tokens"]}
    ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
    if ids != sorted(ids):
        return None
    letters = byte_alphabet()
    return {bytes(letters[c] for c in token): k for token, k in vocab.items() if token not in special}


class _Odd(Exception):
    """A chunk that is empty or ends in white space: its text needs a closer look."""


class _Chunks(dict):
    """Ids of chunks, made when first asked for."""

    def __init__(self, make, lead: str, limit: int):
        super().__init__()
        self.make, self.lead, self.limit = make, lead, limit

    def __missing__(self, key: str) -> bytes:
        if self.lead and (not key or key[-1].isspace()):
            raise _Odd
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(self.lead + key)
        return value


class ChunkEncoder:
    """Ids of whole texts as the tokenizers library gives them (add_special_tokens=False), as little-endian uint32 bytes.

    The pre-tokenizer never joins a word with what stands before the single space in front of it, so a text is the
    concatenation of its space-led chunks, and each distinct chunk is encoded once. Texts in which white space meets a
    space on both sides (where that doesn't hold), or with the string of a special token, are encoded as they are. Where the file
    allows it, chunks are merged by tiktoken over the file's own vocabulary, which takes short strings in less time; the ids
    are the same. The cache is emptied when full; that only costs time.
    """

    def __init__(self, path: str, limit: int = 500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path, self.tokenizer)
        if ranks:
            import tiktoken

            ordinary = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._short = lambda text: array("I", ordinary(text)).tobytes()
        else:
            self._short = self._whole
        self.first, self.later = _Chunks(self._short, "", limit // 10), _Chunks(self._short, " ", limit)
        self.chunked = ranks is not None

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def one(self, text: str) -> bytes:
        if not self.chunked or any(s in text for s in self.special):
            return self._whole(text)
        parts = text.split(" ")
        try:
            return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        except _Odd:
            if _JOINED.search(text):
                return self._short(text)
            return self.first[parts[0]] + b"".join([self._short(" " + p) for p in parts[1:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(t) for t in texts]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One a worker, kept between tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def encoded(batches, text_at: int, path: str):
    """(batch, ids of each row as uint32 bytes), a few hundred texts at a time."""
    from .common import small_batches, strings

    enc = encoder(path)
    for b in small_batches(batches, 2.0):
        yield b, enc.encode(strings(b, text_at))


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary."""
    t = Tokenizer.from_file(path)
    vocab = t.get_vocab(with_added_tokens=False)
    out = np.zeros(max(t.get_vocab(with_added_tokens=True).values()) + 1, np.int64)
    for token, k in vocab.items():
        out[k] = len(token)  # the alphabet has one character for each byte
    for k, added in t.get_added_tokens_decoder().items():
        out[k] = len(added.content.encode())
    return out


def arrow_longs(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64))
