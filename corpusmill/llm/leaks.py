"""Problem 9: evaluation texts inside the corpus.

Winnowing: of every window of consecutive k-gram hashes the least (the rightmost of equal ones) is kept. Any shared run of
at least k + window - 1 words has a fingerprint in common. Fingerprints of both sides are joined; each hit is extended in
both directions over equal words, and runs that are long enough are reported.

Defined results: null ids are left out; null and short texts have no fingerprints; an item without a passage is searched by its question alone;
repeated rows count once; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut, small
from .ragged import flat, runs

K, WINDOW, LEAST = 6, 7, 12  # K + WINDOW - 1 = LEAST


def winnow(values: np.ndarray, offsets: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row and hash of each fingerprint."""
    h, off = runs(values, offsets, k)
    rows = np.repeat(np.arange(len(off) - 1), np.diff(off))
    span = np.maximum(np.diff(off) - window + 1, 0)
    begin = np.zeros(len(off), np.int64)
    np.cumsum(span, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(off[:-1] - begin[:-1], span)
    best, least = at.copy(), h[at] if len(at) else h[:0]
    for j in range(1, window):
        x = h[at + j]
        better = x <= least
        least = np.where(better, x, least)
        best = np.where(better, at + j, best)
    chosen = best[np.r_[True, best[1:] != best[:-1]]] if len(best) else best
    return rows[chosen], chosen - off[rows[chosen]], h[chosen]


def fingerprints(df: DataFrame, keys: list[str], k: int = K, window: int = WINDOW) -> DataFrame:
    """keys, pos, fp from a table with keys and w (word hashes)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", pos int, fp long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                rows, pos, fp = winnow(*flat(b.column(len(keys))), k, window)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).take(take) for i in range(len(keys))] + [pa.array(pos.astype(np.int32)), pa.array(fp.view(np.int64))], names=[*keys, "pos", "fp"]
                )

    return df.select(*keys, "w").mapInArrow(work, schema)


def extend(doc: np.ndarray, item: np.ndarray, d: int, g: int, k: int = K) -> tuple[int, int, int]:
    """The longest run of equal words around a hit: its start in both texts and its length; length 0 if the hit is false."""
    if not np.array_equal(doc[d : d + k], item[g : g + k]):
        return d, g, 0
    n = min(d, g)
    differ = np.flatnonzero(doc[d - n : d] != item[g - n : g])
    back = n - 1 - differ[-1] if len(differ) else n
    n = min(len(doc) - d, len(item) - g)
    differ = np.flatnonzero(doc[d : d + n] != item[g : g + n])
    ahead = differ[0] if len(differ) else n
    return d - back, g - back, int(back + ahead)


def spans(documents: DataFrame, gold: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, gold_id, field, doc_start, item_start, length): every shared run of at least ``least`` words, in words."""
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("t")) for c in ("q", "passage"))))
    documents = documents.where("doc_id is not null")
    items = gold.where("gold_id is not null").select(F.col("gold_id").cast("string").alias("gold_id"), fields.alias("f")).select("gold_id", "f.field", F.col("f.t").alias("t")).where("t is not null").dropDuplicates()
    items = cut(items.select("gold_id", "field", T.word_hashes(F.col("t")).alias("w")))
    test = fingerprints(items, ["gold_id", "field"]).withColumnRenamed("pos", "g").distinct()
    docs = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), T.word_hashes(F.col("text")).alias("w"))
    hits = cut(fingerprints(docs, ["doc_id"]).join(small(test), "fp").select("doc_id", "gold_id", "field", "pos", "g").distinct())
    # fingerprints of one shared run lie on one diagonal; the first and the last are enough to extend from only if no other
    # run shares it, so all are kept
    seeds = hits.groupBy("doc_id", "gold_id", "field").agg(F.collect_list(F.struct("pos", "g")).alias("hits"))
    ids = small(hits.select("doc_id").distinct())
    held = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    held = held.dropDuplicates().select("doc_id", T.word_hashes(F.col("text")).alias("dw"))
    joined = held.join(seeds, "doc_id").join(small(items), ["gold_id", "field"]).select("doc_id", "gold_id", "field", "dw", "w", "hits")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            ids, golds, fields = (b.column(i).to_pylist() for i in range(3))
            for i in range(b.num_rows):
                dw, gw = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4))
                done: dict[int, int] = {}
                for h in sorted((x["pos"], x["g"]) for x in b.column(5)[i].as_py()):
                    if done.get(h[0] - h[1], -1) >= h[0]:
                        continue
                    s, g, n = extend(dw, gw, *h)
                    if n:
                        done[h[0] - h[1]] = s + n - K
                    if n >= least:
                        out.add((ids[i], golds[i], fields[i], s, g, n))
            cols = list(zip(*sorted(out))) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "gold_id", "field", "doc_start", "item_start", "length"])

    return joined.mapInArrow(work, "doc_id long, gold_id string, field string, doc_start int, item_start int, length int")


def leaked(documents: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, gold_id) of the documents that hold a part of an evaluation item."""
    return spans(documents, gold).select("doc_id", "gold_id").distinct()
