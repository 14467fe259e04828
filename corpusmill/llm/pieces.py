"""Problem 5: cutting oversized texts at natural boundaries.

A text is parted by a hierarchy of separators: section, paragraph, sentence, word, character; only what is still too long
is parted by the next one. The parts are packed greedily; every piece after the first begins exactly ``overlap``
characters before the end of the piece before it, so the text can be put together again from the pieces. A part is parted
further only where it doesn't fit into a piece of its own, of which the overlap takes a share.

Defined results: null ids, null texts and texts of at most ``limit`` characters give no pieces; a row delivered twice counts once;
lengths are Unicode code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1800, 200
#: A cut may be made at the end of each match.
SEPARATORS = [
    re.compile(r"\n(?=[ \t]*(?:#{1,6}[ \t]|\d+(?:\.\d+)*\.?[ \t]+\w))"),
    re.compile(r"\n[ \t\r]*\n+"),
    re.compile(r"\n|[.!?…](?=\s)\s+|[。！？；]"),
    re.compile(r"\s+|[、，]"),
]


def atoms(text: str, start: int, end: int, most: int, level: int = 0) -> list[int]:
    """Ends of the parts of text[start:end], none longer than ``most``, parted by the highest separators that serve."""
    if end - start <= most:
        return [end]
    if level == len(SEPARATORS):
        return [*range(start + most, end, most), end]
    cuts = [m.end() for m in SEPARATORS[level].finditer(text, start, end) if start < m.end() < end]
    out, at = [], start
    for cut in [*cuts, end]:
        out += atoms(text, at, cut, most, level + 1)
        at = cut
    return out


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of each piece."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    out, start, end = [], 0, 0
    for whole in atoms(text, 0, len(text), limit):
        if whole - start > limit and end > start:
            out.append((start, end))
            start = max(0, end - overlap)
        for cut in [whole] if whole - start <= limit else atoms(text, end, whole, limit - overlap):
            if cut - start > limit:
                out.append((start, end))
                start = max(0, end - overlap)
            end = cut
    if end > start:
        out.append((start, end))
    return out


def pieces(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, seq, piece, start, text) of the chunks above the limit; piece counts from 0 in each chunk."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (c, q, k, s, t[s:e])
                for c, q, t in zip(*(x.to_pylist() for x in b.columns))
                for k, (s, e) in enumerate(spans(t, limit, overlap))
            ]
            cols = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["chunk_id", "seq", "piece", "start", "text"])

    long = df.where((F.length("text") > limit) & F.col("chunk_id").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("seq").cast("int").alias("seq"), "text")
    return long.dropDuplicates().mapInArrow(split, "chunk_id long, seq int, piece int, start int, text string")


def oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id of the chunks that were cut."""
    return pieces(df, limit, overlap).where("piece = 1").select("chunk_id").distinct()
