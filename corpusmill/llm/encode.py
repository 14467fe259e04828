"""Problem 8: token ids of whole texts by a public byte-level BPE vocabulary.

A sentencepiece BPE model is written directly from the vocabulary: every token is a piece whose bytes are mapped to one
character each, scored by its negative rank, with identity normalisation. Merging the neighbouring pair of the highest
score is then the same as merging the pair of the lowest rank. Texts are parted into pre-tokens on the JVM; each distinct
pre-token of a batch is encoded once.

Defined results: every row gives one row, also of a null id; null and empty texts give an empty list; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ragged import flat, take_ragged

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Unicode's White_Space characters, and the vocabulary's pre-token pattern over them.
SPACE = "\\t-\\r \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
PRETOKEN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pre-tokens remembered by a worker; the memory starts anew when it is full.
REMEMBERED = 300_000


@lru_cache
def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(path: str) -> bytes:
    """The serialised model: pieces in order of rank, then the piece for what is unknown (never met, all bytes being pieces)."""
    chars = byte_chars()
    by_rank = sorted((r, t) for t, r in ranks(path).items())
    if [r for r, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    pieces = [_field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(r)) + _field(3, 1) for r, t in by_rank]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model_bytes(path))


class Encoder:
    def __init__(self, path: str):
        self.model, self.known = _processor(path), {}
        self.table = {b: c for b, c in enumerate(byte_chars())}

    def __call__(self, pretokens: list[str]) -> list[list[int]]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in pretokens if p not in self.known]
        if new:
            ids = self.model.encode([p.encode().decode("latin-1").translate(self.table) for p in new], num_threads=1)
            self.known.update(zip(new, ids))
        return [self.known[p] for p in pretokens]


def ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                words = b.column(1)
                lengths = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                coded = words.flatten().dictionary_encode()
                lists = encoder(coded.dictionary.to_pylist())
                offsets = np.zeros(len(lists) + 1, np.int64)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.fromiter((i for x in lists for i in x), np.int32, offsets[-1])
                values, at_word = take_ragged(values, offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
                ends = np.zeros(len(lengths) + 1, np.int64)
                np.cumsum(lengths, out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(at_word[ends].astype(np.int32)), pa.array(values))], names=["doc_id", "ids"]
                )

    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(PRETOKEN), F.lit(0))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("w")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), by the inverse mapping."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {r: t for t, r in ranks(vocabulary).items()}
        for b in batches:
            texts = [b"".join(tokens[i] for i in x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(back, "doc_id long, text string")
