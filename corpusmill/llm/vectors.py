"""Problem 6: the most similar vectors of every vector.

The space is divided into cells around centroids fitted on a bounded sample; every row is indexed in the shard of its own
cell. In each shard a robust-pruned directed graph is built: greedy searches propose the neighbours of a point, relaxed
distance pruning keeps diverse edges. Every vector searches the finished graphs of its own cell and of cells nearly as near,
by beam search; the best of all shards are kept.

Equal vectors are one point, so that a group of copies, however large, is no crowd in a graph; its members get their copies
and the point's neighbours in the end. Large cells are dealt into several shards and their queries into several tasks, so no
task grows with a cell.

Defined results: vectors that are null, of another length, with null, NaN or infinite numbers, or all zero are neither
indexed nor asked for; a row delivered twice counts once; ties are broken by the smaller id; a collection of one vector
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, parts, small
from .cells import Cells
from .graph import beam_search, build, entry_points
from .ragged import flat, pack, unpack

DIM = 64
#: Rows the centroids are fitted on at least, for each cell, and at most.
FIT_ROWS, FIT_EACH, FIT_MOST = 20_000, 32, 200_000
#: Rows of a shard while there are few; the number of cells grows with the power POWER of that of the rows, so shards grow
#: slowly too: a search in a larger graph is hardly longer, but neighbours are spread over fewer cells.
SHARD_ROWS, POWER, QUERY_ROWS = 4096, 0.75, 65_536
DEGREE, BUILD_WIDTH, ALPHA = 24, 24, 1.02
#: The beam of asking, and the cells asked: those within MARGIN of the nearest, at least MOST of them or twice the root of their number.
WIDTH, MOST, MARGIN = 32, 5, 0.15


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    v = F.col(vector_col)
    inf = float("inf")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    return df.where(F.col(id_col).isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("v")
    )


def matrix(column, dim: int) -> np.ndarray:
    """Unit rows of a list column."""
    x = flat(column)[0].reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True) if len(x) else 1
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def cells_of(n: int) -> int:
    return max(1, round((n / SHARD_ROWS) ** POWER))


def fitted(rows: DataFrame, dim: int, n: int, most: int | None = None, margin: float = MARGIN) -> Cells:
    """Cells for n rows (id, v), from a sample of at most FIT_MOST of them."""
    many = cells_of(n)
    want = min(FIT_MOST, max(FIT_ROWS, FIT_EACH * many))
    t = rows.select("v").sample(min(1.0, 1.2 * want / max(1, n)), seed=11).limit(want).toArrow()
    return Cells.of(matrix(t.column(0), dim), n, many, most or max(MOST, math.ceil(2 * math.sqrt(many))), margin)


def neighbours(df: DataFrame, k: int = 10, least: float = -2.0, width: int = WIDTH, most: int | None = None, margin: float = MARGIN, id_col: str = "chunk_id", vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """(id, neighbour, similarity, place): up to k neighbours of each vector with at least the similarity ``least``, place from 1."""
    rows = usable(df, id_col, vector_col, dim).select("id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"))
    n = rows.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], "id long, neighbour long, similarity double, place int")
    copied = small(cut(rows.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep < last").select("h", "h2", "rep")))
    marked = rows.join(copied, ["h", "h2"], "left")
    points = marked.where("rep is null or rep = id").select("id", "v")
    cells = fitted(points, dim, n, most, margin)
    salts = cells.salts(n, max(QUERY_ROWS, 3 * n // len(cells.share)))

    def deal(batches):
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                t = b.slice(s, 2000)
                ids, x = t.column(0).to_numpy(), matrix(t.column(1), dim)
                r, cell, sub, salt, indexed, asked = cells.deal(ids, x, salts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(sub), pa.array(salt), pa.array(ids[r]), pa.array(indexed), pa.array(asked), pack(x[r])],
                    names=["cell", "sub", "salt", "id", "indexed", "asked", "v"],
                )

    def search(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        x = unpack(t.column("v"), np.float32, dim)
        indexed, asked = t.column("indexed").to_numpy(), t.column("asked").to_numpy()
        at = np.flatnonzero(indexed)
        at = at[np.unique(ids[at], return_index=True)[1]]  # a row delivered twice is one point
        at = np.random.default_rng(len(at)).permutation(at)
        points, own = np.ascontiguousarray(x[at]), ids[at]
        graph = build(points, DEGREE, BUILD_WIDTH, ALPHA)
        ask = np.flatnonzero(asked)
        ask = ask[np.unique(ids[ask], return_index=True)[1]]
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(at) and len(ask):
            i, s = beam_search(points, graph, np.ascontiguousarray(x[ask]), width, entry_points(len(points)))
            met = np.where(i >= 0, own[i], -1)
            s = np.where((i >= 0) & (met != ids[ask][:, None]) & (s >= least), s, -np.inf)
            order = np.lexsort((met, -s), axis=1)[:, :k]
            met, s = np.take_along_axis(met, order, 1), np.take_along_axis(s, order, 1)
            r, c = np.nonzero(s > -np.inf)
            out = [ids[ask][r], met[r, c], s[r, c].astype(np.float64)]
        return pa.Table.from_arrays([pa.array(c) for c in out], names=["id", "neighbour", "similarity"])

    dealt = points.mapInArrow(deal, "cell long, sub long, salt long, id long, indexed boolean, asked boolean, v binary")
    # a number of one's own: by size alone AQE would put many shards, small but long in work, into one task; more partitions than
    # shards, so that few of them meet in one by their hashes
    tasks = max(parts(df.sparkSession), min(20_000, 8 * int((cells.subs * salts).sum())))
    found = dealt.repartition(tasks, "cell", "sub", "salt").groupBy("cell", "sub", "salt").applyInArrow(search, "id long, neighbour long, similarity double")
    member = cut(marked.where("rep is not null").select("id", "rep").distinct())
    if not member.isEmpty():
        found = with_copies(cut(found), member, k, least)
    # one exchange by id serves both the join of repeated pairs and the ranks
    once = found.repartition("id").groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def with_copies(found: DataFrame, member: DataFrame, k: int, least: float) -> DataFrame:
    """Neighbours of points as those of all vectors; member: (id, rep) of each vector that has copies.

    Of a group of copies only the k + 1 smallest ids can be among the k nearest of anything, so no more are given out.
    """
    first = member.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1)
    first = small(cut(first.select("rep", F.col("id").alias("one"))))
    wide = found.join(first, found["neighbour"] == first["rep"], "left").select("id", F.coalesce("one", "neighbour").alias("neighbour"), "similarity")
    copied = small(cut(wide.join(small(member.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")))
    others = member.where("id <> rep").select(F.col("id").alias("other"), "rep").join(copied, F.col("rep") == copied["id"]).select(F.col("other").alias("id"), "neighbour", "similarity")
    own = member.join(first, "rep").where("id <> one").select("id", F.col("one").alias("neighbour"), F.lit(1.0).alias("similarity"))
    return wide.union(others).union(own.where(F.lit(least) <= 1.0)).where("id <> neighbour")


def similar(df: DataFrame, least: float = 0.9) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a smaller: pairs of at least that cosine among the ten most similar of either."""
    found = neighbours(df, least=least - 1e-6).where(F.col("similarity") >= least)
    return found.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()


def ten(df: DataFrame) -> DataFrame:
    """(chunk_id, neighbour_id, rank, cosine): the ten most similar of every usable chunk."""
    return neighbours(df).select(F.col("id").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.col("place").alias("rank"), F.col("similarity").alias("cosine"))
