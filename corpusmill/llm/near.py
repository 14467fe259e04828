"""Problem 7: near-duplicate records with small edits.

The signature of a text is a b-bit MinHash of its runs of three words: the lowest BITS bits of each of SLOTS minima. The
distance of two signatures is the number of slots in which they differ (Hamming distance). The slots are split into CHUNKS
chunks. Two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 slots have, by the pigeonhole principle, a chunk in
which at most ERRORS slots differ; so every chunk is entered into the index once for each choice of ERRORS slots to be left
out, and each pair within that distance meets under a common key. Pairs that meet are kept if no more than FAR slots differ,
which is beyond the distance that is guaranteed, and compared by their exact similarity. Of signatures the lowest eight bits
of each slot travel with a key; slots equal by accident make a distance smaller, never larger.

Texts with the same words are one representative until the end. The index is range-partitioned by key and id, so that a key
under which very many texts meet is spread over partitions; its texts are then compared block by block in tasks of their own.

Defined results: null ids, null texts and texts of fewer than MIN_WORDS words are similar to nothing; a row delivered twice
counts once; copies in the sense of problem 2 are no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.components import connected_components
from ..runtime import cut, parts, small
from .copies import FIELD_BREAKS, field_key
from .graph import one_thread
from .ragged import flat, minima, mix, rows_of, runs

SHINGLE, MIN_WORDS = 3, 30
SLOTS, CHUNKS, ERRORS, BITS = 24, 6, 1, 16
#: Runs of one key longer than this are compared in blocks of this size, each pair of blocks by a task of its own.
BLOCK = 512
#: Bits of the map of a text's shingles, by which pairs of a block are bounded.
MAP = 512


def far(threshold: float) -> int:
    """The least distance that signatures of a pair of just that similarity exceed but once in 3,000 cases; never below what is guaranteed."""
    p, most = 1 - threshold, CHUNKS * (ERRORS + 1) - 1
    beyond = lambda d: sum(comb(SLOTS, k) * p**k * (1 - p) ** (SLOTS - k) for k in range(d + 1, SLOTS + 1))
    return next(d for d in range(most, SLOTS + 1) if beyond(d) < 1 / 3000)


def signature(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The b-bit MinHash of each row: rows by SLOTS."""
    return minima(hashes, offsets, SLOTS) & np.uint32(2**BITS - 1)


def keys(sig: np.ndarray) -> np.ndarray:
    """All index keys of each signature: rows by CHUNKS * C(SLOTS / CHUNKS, ERRORS)."""
    m = sig.astype(np.uint64)
    size = SLOTS // CHUNKS
    out = []
    for c in range(CHUNKS):
        for k, left in enumerate(combinations(range(size), size - ERRORS)):
            h = np.full(len(m), c * 1000 + k + 1, np.uint64)
            for j in left:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, c * size + j])
            out.append(h)
    return np.stack(out, 1) if len(m) else np.zeros((0, len(out)), np.uint64)


_LOW = [f"s{i}" for i in range(SLOTS // 8)]
_INDEX = "key long, id long, " + ", ".join(f"{c} long" for c in _LOW)


def index(rows: DataFrame) -> DataFrame:
    """(key, id, s0, ...): every key of each row's signature, with the low bytes of it; rows has id and w (word hashes)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                sig = signature(*runs(*flat(b.column(1)), SHINGLE))
                k, low = keys(sig), np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64)
                n = k.shape[1]
                cols = [k.ravel().view(np.int64), np.repeat(b.column(0).to_numpy(), n), *(np.repeat(low[:, c], n) for c in range(low.shape[1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "id", *_LOW])

    return rows.select("id", "w").mapInArrow(work, _INDEX)


def _scan(most: int):
    """Scan of rows sorted by key: pairs that meet within the distance (key null), and the rows of long runs and of a partition's
    first and last run (b null)."""
    names = ["a", "b", "key"]

    def work(key: np.ndarray, ids: np.ndarray, low: np.ndarray, begins: bool, ends: bool):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        lengths = np.diff(np.r_[starts, len(key)])
        apart = lengths > BLOCK
        apart[0] |= begins
        apart[-1] |= ends
        run, place, live = np.repeat(lengths, lengths), np.arange(len(key)) - np.repeat(starts, lengths), ~np.repeat(apart, lengths)
        if not live.all():
            yield pa.RecordBatch.from_arrays([pa.array(ids[~live]), pa.nulls(int((~live).sum()), pa.int64()), pa.array(key[~live])], names=names)
        for d in range(1, int(lengths[~apart].max(initial=1))):  # row and its d-th neighbour
            a = np.flatnonzero(live & (place + d < run))
            a = a[((low[a] != low[a + d]).sum(1) <= most) & (ids[a] != ids[a + d])]
            if len(a):
                x, y = ids[a], ids[a + d]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(a), pa.int64())], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, begins = None, True
        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(0).to_numpy(), b.column(1).to_numpy(), np.stack([b.column(2 + c).to_numpy() for c in range(len(_LOW))], 1).view(np.uint8)]
            now = now if rest is None else [np.concatenate(c) for c in zip(rest, now)]
            key = now[0]
            last = int(np.searchsorted(key, key[-1]))
            if not last or len(key) - last > BLOCK:  # a long run may go on: what is here of it is given out at once
                yield from work(*now, begins, True)
                rest, begins = None, True
            else:
                yield from work(*(c[:last] for c in now), begins, False)
                rest, begins = [c[last:] for c in now], False
        if rest is not None:
            yield from work(*rest, begins, True)

    return scan


def candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of ids whose signatures meet under a key; rows has id and w (word hashes), and is a written table: the
    range partitioner looks at the keys before they are dealt."""
    n = parts(rows.sparkSession)
    met = cut(index(rows).repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id").mapInArrow(_scan(far(threshold)), "a long, b long, key long"))
    pairs = met.where("b is not null").select("a", "b").distinct()
    apart = met.where("b is null").select(F.col("a").alias("id"), "key").distinct()
    return pairs if apart.isEmpty() else pairs.union(_blocks(apart, rows, threshold)).distinct()


def _maps(rows: DataFrame) -> DataFrame:
    """(id, n, map): the number of different shingles of each row, and a map of MAP bits in which each has set one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                h, off = runs(*flat(b.column(1)), SHINGLE)
                row = rows_of(off)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                once = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
                row, h = row[once], h[once]
                bits = np.zeros((b.num_rows, MAP), np.uint8)
                bits[row, (h % np.uint64(MAP)).astype(np.int64)] = 1
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(row, minlength=b.num_rows)), pa.array([x.tobytes() for x in packed], pa.binary())], names=["id", "n", "map"])

    return rows.select("id", "w").mapInArrow(work, "id long, n long, map binary")


def may_be_similar(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows of two bit matrices can reach the threshold: a shingle of one whose bit the other lacks is in one only,
    so of d such bits at most n - d shingles are common and at least n + d of the other's are in either."""
    both = a @ b.T
    only_a, only_b = a.sum(1)[:, None] - both, b.sum(1)[None] - both
    na, nb = na[:, None], nb[None]
    return ((na - only_a) >= threshold * (nb + only_a) - 1e-6) & ((nb - only_b) >= threshold * (na + only_b) - 1e-6)


def _blocks(apart: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs within the runs (id, key) kept apart: each run is dealt into blocks, and each two blocks of a run are compared in a group of their own."""
    apart = cut(apart)
    maps = cut(_maps(rows.join(small(apart.select("id").distinct()), "id", "left_semi").dropDuplicates(["id"])))
    blocks = small(apart.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")))
    dealt = apart.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), "n_blocks").cast("int")).join(small(maps), "id")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    placed = dealt.withColumn("other", other).select("key", "id", "n", "map", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(t: pa.Table) -> pa.Table:
        one_thread()
        ids, n, block = (t.column(c).to_numpy() for c in ("id", "n", "block"))
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        maps = np.frombuffer(b"".join(t.column("map").to_pylist()), np.uint8).reshape(len(ids), -1)
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        right_bits = np.unpackbits(maps[right], axis=1).astype(np.float32)
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            bits = np.unpackbits(maps[i], axis=1).astype(np.float32)
            r, c = np.nonzero(may_be_similar(bits, right_bits, n[i], n[right], threshold))
            p, q = ids[i[r]], ids[right[c]]
            found.append((np.minimum(p, q)[p != q], np.maximum(p, q)[p != q]))
        a, b = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": a, "b": b})

    return placed.groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")


def shingle_set(w: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(w[i - 1], w[i], w[i + 1])))


def verified(pairs: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs of at least the threshold; rows has id and w, of which the needed ones are fetched."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(rows.join(small(cut(needed)), "id", "left_semi").select("id", shingle_set(F.col("w")).alias("s")))
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    fits = F.least(F.size("sa"), F.size("sb")) >= F.greatest(F.size("sa"), F.size("sb")) * threshold - 1e-9  # else they can't be similar enough
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.where(fits).select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("ab")).where(
        F.col("ab") >= (F.col("na") + F.col("nb") - F.col("ab")) * threshold - 1e-9
    ).select("a", "b", (F.col("ab") / (F.col("na") + F.col("nb") - F.col("ab"))).alias("similarity"))


def near_pairs(df: DataFrame, threshold: float = 0.8, id_col: str = "chunk_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (a, b, similarity), and membership (id, rep, fk)."""
    t = F.col(text_col)
    record = t.rlike("[:=]") & t.rlike(f"(?s){FIELD_BREAKS}.*{FIELD_BREAKS}")
    rows = cut(
        df.where(t.isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), T.word_hashes(t).alias("w"), F.when(record, field_key(t)).alias("f"))
        .where(F.size("w") >= MIN_WORDS)
        .select("id", "w", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("h2"), F.when(F.col("f").isNotNull(), F.xxhash64("f")).alias("fk"))
    )
    least = rows.groupBy("h", "h2").agg(F.min("id").alias("rep"))
    member = cut(rows.select("id", "h", "h2", "fk").join(least, ["h", "h2"]).select("id", "rep", "fk").distinct())
    others = small(member.where("id <> rep").select("id").distinct())
    reps = rows.join(others, "id", "left_anti").select("id", "w")
    pairs = cut(candidates(reps, threshold))
    return cut(verified(pairs, reps.dropDuplicates(["id"]), threshold)), member


def found(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a smaller: all pairs of chunks of at least that similarity that aren't copies."""
    pairs, member = near_pairs(df, threshold)
    side = lambda x: member.select(F.col("rep").alias(x), F.col("id").alias(f"id_{x}"), F.col("fk").alias(f"fk_{x}"))
    p = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("fk_a is null or fk_b is null or fk_a <> fk_b")
    return p.select(F.least("id_a", "id_b").alias("chunk_id_a"), F.greatest("id_a", "id_b").alias("chunk_id_b")).distinct()


def groups(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(chunk_id, group, links): one row per chunk of MIN_WORDS words or more; the group is the least id reached over similar texts."""
    pairs, member = near_pairs(df, threshold)
    labels = connected_components(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    out = member.select(F.col("id").alias("chunk_id"), "rep").distinct().join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").join(ends, "rep", "left")
    return out.select("chunk_id", F.coalesce("component", "rep").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
