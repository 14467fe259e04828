"""Exact and near-duplicate documents: normalised digests, MinHash, banded candidates, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut, small
from .components import connected_components
from .segmentation import bottom, shingles

SLOTS, BANDS, SHINGLE_CAP, EXACT_CHARS, NEAR_CHARS = 64, 16, 800, 40, 300
#: Representatives of one block of a bucket. It changes no result.
BUCKET = 1000
#: Slot i is salted with i * 2654435761 modulo 2^32.
SEEDS = [(i * 2654435761) % 2**32 for i in range(SLOTS)]


def exact_groups(docs: DataFrame) -> DataFrame:
    """(digest, members, least_id) of documents of more than 40 normalised characters that are equal after normalisation."""
    t = docs.select("doc_id", T.normalised(F.col("text")).alias("t")).where(F.length("t") > EXACT_CHARS)
    return t.groupBy(F.sha1("t").alias("digest")).agg(F.count("*").alias("members"), F.min("doc_id").alias("least_id")).where("members > 1")


def hashes(text: Column, hashed=T.hash32) -> Column:
    """The bottom 800 shingle hashes; ``hashed`` gives a 32-bit hash of a string column."""
    return bottom(F.transform(shingles(text), hashed), SHINGLE_CAP)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(n) - n
        sig = np.stack([np.minimum.reduceat(values ^ np.int64(s), starts) for s in SEEDS], 1) if len(n) else np.zeros((0, SLOTS), np.int64)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * SLOTS)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))], names=["doc_id", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, sig) of documents of at least 300 normalised characters: MinHash of 64 slots, the least of hash xor salt.

    Shingles are hashed on the JVM; the minima are taken in Arrow batches, an inner function being interpreted element by
    element and many times slower.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.normalised(F.col("text")).alias("t")).where(F.length("t") >= NEAR_CHARS)
    return t.select("doc_id", hashes(F.col("t")).alias("h")).mapInArrow(_slots, "doc_id long, sig array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / SLOTS


def met_in_blocks(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: reps that meet under a key of (rep, key). A key of many reps is dealt into blocks; each two blocks meet apart."""
    keys = cut(keys)
    many = small(cut(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))))
    dealt = keys.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    left = dealt.select("key", F.col("block").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("y"), F.col("rep").alias("p"))
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), "block")).alias("x"), F.col("block").alias("y"), F.col("rep").alias("q"))
    return left.join(right, ["key", "x", "y"]).where("x < y or p < q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a < b").distinct()


def near_pairs(sigs: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(a, b, similarity), a < b: documents with an equal band of 4 slots and enough equal slots.

    Documents with equal signatures are one representative while candidates are made, so that a large group of copies
    never meets itself; its members are tied to the representative by pairs of similarity 1.
    """
    rows = 64 // BANDS
    keyed = cut(sigs.withColumn("h", F.xxhash64("sig")))
    reps = keyed.groupBy("h", "sig").agg(F.min("doc_id").alias("rep"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.struct(b.alias("band"), F.slice("sig", b * rows + 1, rows).alias("rows")))
    keys = reps.select("rep", F.explode(bands).alias("k")).select("rep", F.xxhash64("k.band", "k.rows").alias("key"))
    met = met_in_blocks(keys)
    side = lambda n: reps.select(F.col("rep").alias(n), F.col("sig").alias(f"s{n}"))
    near = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", estimate(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    copies = keyed.join(reps.select("h", "sig", "rep"), ["h", "sig"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity"))
    return near.union(copies)


def clusters(docs: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(doc_id, cluster, members): components of exact and near-duplicate pairs; the cluster is its least id."""
    t = docs.select("doc_id", T.normalised(F.col("text")).alias("t")).where(F.length("t") > EXACT_CHARS).select("doc_id", F.sha1("t").alias("digest"))
    least = t.groupBy("digest").agg(F.min("doc_id").alias("a"))
    exact = t.join(least, "digest").where("doc_id <> a").select("a", F.col("doc_id").alias("b"))
    labels = connected_components(exact.union(near_pairs(signatures(docs), threshold).select("a", "b")))
    sizes = labels.groupBy("component").agg(F.count("*").alias("members"))
    return labels.join(sizes, "component").select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"), "members")
