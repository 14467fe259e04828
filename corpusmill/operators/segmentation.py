"""Cutting texts into chunks and putting them together again; small text rules of the pipeline. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK_CHARS, OVERLAP = 1800, 200


def windows(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters, each beginning ``size - overlap`` after the one before; the last may lie within the one before it."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / step).cast("int"))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed(text: Column, size: int = CHUNK_CHARS, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed greedily up to ``size`` characters, joined by blank lines; a longer paragraph becomes windows of its own.

    Null gives null, blank text gives an empty array.
    """
    paragraphs = F.filter(F.transform(F.split(text, "\\n\\s*\\n"), T.strip), lambda p: F.length(p) > 0)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    closed = lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.array_append(a["done"], a["open"]))

    def add(a: Column, p: Column) -> Column:
        long = F.length(p) > size
        fits = F.length(a["open"]) + F.length(p) + 2 <= size
        done = F.when(long, F.concat(closed(a), windows(p, size, overlap))).when((a["open"] == "") | fits, a["done"]).otherwise(closed(a))
        rest = F.when(long, F.lit("")).when(a["open"] == "", p).when(fits, F.concat(a["open"], F.lit("\n\n"), p)).otherwise(p)
        return F.struct(done.alias("done"), rest.alias("open"))

    return F.aggregate(paragraphs, start, add, closed)


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_CHARS, overlap: int = OVERLAP, by=packed) -> DataFrame:
    """(doc_id, seq, chunk)."""
    return docs.select(F.col(id_col), F.posexplode(by(F.col(text_col), size, overlap)).alias("seq", "chunk"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """(document_id, text): the chunks of each document in order of seq, joined by blank lines; rows delivered twice count once, null texts are left out."""
    rows = chunks.select("document_id", "chunk_id", "seq", "text").where("text is not null").dropDuplicates(["chunk_id"])
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "text")))
    return rows.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def shingles(text: Column, k: int = 5) -> Column:
    """Set of runs of k tokens of the normalised text; a shorter text is one shingle itself, an empty one has none."""

    def of(t: Column) -> Column:
        runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, k), " ")))
        return F.when(F.size(t) < k, F.array(F.array_join(t, " "))).otherwise(runs)

    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(T.let(F.split(text, " "), of))


def bottom(hashes: Column, most: int = 800) -> Column:
    """The ``most`` least hashes."""
    return F.slice(F.array_sort(hashes), 1, most)


def answer_only(reply: Column) -> Column:
    """What comes after the last reasoning mark, trimmed."""
    return T.strip(F.substring_index(reply, "</think>", -1))


def classification_sample(text: Column) -> Column:
    """Head, middle and tail of a long text, the head of a shorter one; at most 1,200 characters."""
    gap = F.lit("\n...\n")
    middle = F.substring(text, F.floor(F.length(text) / 2).cast("int") + 1, F.lit(400))
    long = F.concat(F.substring(text, 1, 800), gap, middle, gap, F.right(text, F.lit(400)))
    return F.substring(F.when(F.length(text) > 1600, long).otherwise(F.substring(text, 1, 1500)), 1, 1200)


def taxonomy_match(reply: Column, taxonomy: list[str]) -> Column:
    """The first entry contained in the reply, else the last entry."""
    out = F.lit(taxonomy[-1])
    for entry in reversed(taxonomy):
        out = F.when(reply.contains(entry), F.lit(entry)).otherwise(out)
    return out
