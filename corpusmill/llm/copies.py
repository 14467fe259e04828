"""Problem 2: copies hidden by formatting.

Each text gets a canonical key, once. The rows are range-partitioned and externally sorted by (hash of the key, id), so that
a key of which a third of all rows are copies is spread over several partitions. Each partition is scanned once, comparing
the full keys of neighbouring rows; a run that may go on beyond what a scan holds (the first and the last of a partition,
and one longer than a batch) gives one row with its full key, and by these full keys such runs are put together.

Defined results: null ids, null texts and texts without words are left out; a row delivered twice (same id and
key) counts once; ties are broken by the smaller id; other columns are ignored. A text is a register record if it is
made wholly of three or more fields; an empty value is a value without words. A record and a text that isn't one are
copies too if their words are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.components import connected_components
from ..runtime import cut, dispose, parts, small

#: A run of so many rows is given out in pieces. It changes no result.
LONG = 50_000
FIELD_BREAKS = f"[{T.LINE_BREAKS}\\t|;]+"


def field_key(text: Column) -> Column:
    """The fields of a register record in sorted order, each as the words of its name and of its value; else null."""
    pieces = F.filter(F.split(text, FIELD_BREAKS), lambda p: p.rlike("[^\\s\\p{Z}\\x{FEFF}\\x{200B}]"))
    name = lambda p: F.regexp_extract(p, "^([^:=]*)[:=]", 1)
    value = lambda p: F.regexp_extract(p, "(?s)^[^:=]*[:=](.*)$", 1)
    key = F.array_join(
        F.array_sort(F.transform(pieces, lambda p: F.concat(F.array_join(T.words(name(p)), " "), F.lit("\x02"), F.array_join(T.words(value(p)), " ")))), "\x01"
    )
    record = (F.size(pieces) >= 3) & F.forall(pieces, lambda p: p.rlike("^[^:=]*[\\p{L}\\p{N}][^:=]*[:=]"))
    return F.when(record, key)


def keyed(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, h (hash of the key), wh and wh2 (hashes of the words), key (F and the sorted fields, or W and the words)."""
    t = F.col(text_col)
    digests = lambda c: (F.xxhash64(c), F.xxhash64(F.lit(1), c))  # noqa: E731  (two independent seeds)
    # a cheap test first: only texts with enough separators are parsed as records
    may = t.rlike("[:=]") & t.rlike(f"(?s){FIELD_BREAKS}.*{FIELD_BREAKS}")
    key = F.when(F.col("f").isNotNull(), F.concat(F.lit("F"), "f")).otherwise(F.concat(F.lit("W"), "words"))
    return (
        df.where(t.isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), T.words(t).alias("w"), F.when(may, field_key(t)).alias("f"))
        .where(F.size("w") > 0)
        .select("id", F.array_join("w", " ").alias("words"), "f")
        .select("id", *(x.alias(n) for x, n in zip(digests("words"), ("wh", "wh2"))), key.alias("key"))
        .select("id", F.xxhash64("key").alias("h"), "wh", "wh2", "key")
    )


_SCANNED = "id long, first long, h long, wh long, wh2 long, open boolean, key string"


def _runs(t: pa.RecordBatch, begins: bool, ends: bool) -> pa.RecordBatch:
    """id, first id of its run, whether that is open, and for the first row of an open run the key. ``begins`` and ``ends`` tell
    that the first and the last run of these rows are open."""
    n = t.num_rows
    ids, h, key, wh, wh2 = (t.column(t.schema.get_field_index(c)) for c in ("id", "h", "key", "wh", "wh2"))
    same = np.zeros(n, bool)
    same[1:] = pc.and_(pc.equal(h.slice(1), h.slice(0, n - 1)), pc.equal(key.slice(1), key.slice(0, n - 1))).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(~same)
    run = np.cumsum(~same) - 1
    opened = (begins & (run == 0)) | (ends & (run == len(starts) - 1))
    i = ids.to_numpy()
    keep = np.r_[True, ~(same[1:] & (i[1:] == i[:-1]))]
    told = key.take(pa.array(np.arange(n), mask=~(opened & ~same)))
    cols = [ids, pa.array(i[starts][run]), h, wh, wh2, pa.array(opened), told]
    return pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in cols], names=["id", "first", "h", "wh", "wh2", "open", "key"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys among neighbours in sorted batches. The last run of a batch waits for the next one, if it isn't all of it."""
    rest, begins = None, True
    for b in batches:
        if not b.num_rows:
            continue
        t = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        h, key = t.column(t.schema.get_field_index("h")), t.column(t.schema.get_field_index("key"))
        last = pc.and_(pc.equal(h, h[-1]), pc.equal(key, key[-1])).to_numpy(zero_copy_only=False)
        last = t.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if not last:
            yield _runs(t, True, True)
            rest, begins = None, True
            continue
        yield _runs(t.slice(0, last), begins, False)
        rest, begins = t.slice(last), False
        if t.num_rows - last >= LONG:
            yield _runs(rest, True, True)
            rest, begins = None, True
    if rest is not None:
        yield _runs(rest, begins, True)


def groups(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(id, gid): gid is the smallest id of the copies of id, itself if there are none."""
    rows = cut(keyed(df, id_col, text_col))  # the range partitioner reads ids and hashes once more, the keys aren't made again
    n = parts(df.sparkSession)
    scanned = cut(rows.repartitionByRange(n, "h", "id").sortWithinPartitions("h", "key", "id").mapInArrow(_scan, _SCANNED))
    dispose(rows)
    pieces = scanned.where("key is not null").select("key", "first", "h")
    least = pieces.join(small(cut(pieces.groupBy("key").agg(F.min("first").alias("gid")))), "key").select("first", "h", "gid").distinct()
    opened = scanned.where("open").select("id", "first", "h", "wh", "wh2").join(small(cut(least)), ["first", "h"])
    found = scanned.where("not open").select("id", F.col("first").alias("gid"), "wh", "wh2").union(opened.select("id", "gid", "wh", "wh2").distinct())
    # a record and another text with the same words belong together although their keys differ
    mixed = found.groupBy("wh", "wh2").agg(F.min("gid").alias("a"), F.max("gid").alias("z")).where("a <> z").select("wh", "wh2", "a")
    mixed = cut(mixed)
    links = found.join(mixed, ["wh", "wh2"]).where("a <> gid").select("a", F.col("gid").alias("b"))
    found = found.select("id", "gid")
    if mixed.isEmpty():
        return found
    joined = connected_components(links).select(F.col("id").alias("gid"), "component")
    return found.join(small(joined), "gid", "left").select("id", F.coalesce("component", "gid").alias("gid")).distinct()


def copies(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Each row that is not the smallest of its copies, with that smallest id."""
    return groups(df, id_col, text_col).where("id <> gid").select(F.col("gid").alias("chunk_id_a"), F.col("id").alias("chunk_id_b"))


def counts(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """One representative of each group of copies with the exact number of its copies."""
    return groups(df, id_col, text_col).groupBy("gid").agg(F.count("*").alias("n")).select(F.col("gid").alias("chunk_id"), F.col("n").alias("copies"))
