"""Measures what problems 1 and 6 find against exhaustive search: python -m corpusmill.llm.measure p1|p6 SF_DIR [--shard ROWS ...].

Exhaustive search is brute force on one machine, so it is meant for the test tables. ``--shard`` scales the rows of a shard
down, so that there are as many cells as a larger collection would have.
"""

from __future__ import annotations

import argparse
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..runtime import cut, local_session, parts, shared_dir, table
from . import history, vectors
from .ragged import unpack


def exhaustive(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The k nearest points of each query (numbers of points), itself left out."""
    out = []
    for at in range(0, len(queries), 1000):
        q = queries[at : at + 1000]
        s = x[q] @ x.T
        s[np.arange(len(q)), q] = -9
        near = np.argpartition(-s, k, axis=1)[:, :k]
        out.append(near)
    return np.concatenate(out)


def recall_of_ten(spark, df, every: int = 20) -> dict:
    """Recall of p6_ten at every ``every``-th vector, and the pairs of a cosine of 0.9 found and missed by p6_found."""
    t = vectors.usable(df, "chunk_id", "embedding", vectors.DIM).dropDuplicates(["id"]).toArrow()
    ids, x = t.column(0).to_numpy(), vectors.matrix(t.column(1), vectors.DIM)
    q = np.arange(0, len(ids), every)
    true = exhaustive(x, q, 10)
    near = vectors.neighbours(df).where(F.col("id").isin([int(i) for i in ids[q]]) if len(q) <= 2000 else F.lit(True)).select("id", "neighbour").toArrow()
    got = set(zip(near.column(0).to_pylist(), near.column(1).to_pylist()))
    hit = sum((int(ids[a]), int(ids[b])) in got for a, row in zip(q, true) for b in row)
    pairs = {(int(r[0]), int(r[1])) for r in vectors.similar(df).collect()}
    want = set()
    for at in range(0, len(ids), 1000):
        s = x[at : at + 1000] @ x.T
        r, c = np.nonzero(s >= 0.9)
        want |= {(int(min(a, b)), int(max(a, b))) for a, b in zip(ids[at + r], ids[c]) if a != b}
    return {"vectors": len(ids), "cells": vectors.cells_of(len(ids)), "recall_of_ten": round(hit / true.size, 4), "pairs": len(want), "pairs_found": len(pairs & want), "pairs_false": len(pairs - want)}


def recall_of_index(spark, documents, every: int = 5, floor: float = history.FLOOR) -> dict:
    """Recall of the index of problem 1 for its own points: of all at a cosine of 0.85 or more that stand before a point of a second
    segment, how many it meets. The documents are dealt into two segments."""
    rows = documents.where("doc_id is not null").select((F.col("doc_id").cast("long") * 2).alias("id"), F.lit(0).cast("long").alias("batch"), F.lit(None).cast("string").alias("sha"), "text")
    records = cut(history.recorded(rows))
    first, second = records.where(f"pmod(xxhash64(id), {every}) <> 0"), records.where(f"pmod(xxhash64(id), {every}) = 0")
    points = records.where("v is not null")
    n = points.count()
    path = f"{shared_dir(spark)}/measure-{uuid.uuid4().hex}"
    index = history.HistoryIndex.create(spark, f"{path}/index", history.cells_for(points, n))
    index.take(first)
    index.take(second, f"{path}/out")
    met = {(r[0], r[1]) for r in spark.read.schema("id long, met long, cosine double").option("recursiveFileLookup", "true").parquet(f"{path}/out/met").select("id", "met").collect()}
    told = {r[0] for r in spark.read.schema("id long, exact boolean, same boolean").option("recursiveFileLookup", "true").parquet(f"{path}/out/told").select("id").collect()}
    a, b = (d.where("v is not null").dropDuplicates(["w"]).select("id", "v").toArrow() for d in (first, second))
    x, y = unpack(a.column(1), np.float32, history.BITS), unpack(b.column(1), np.float32, history.BITS)
    ids, asks = a.column(0).to_numpy(), b.column(0).to_numpy()
    want = {(int(asks[at + r]), int(ids[c])) for at in range(0, len(asks), 1000) for r, c in np.argwhere(y[at : at + 1000] @ x.T >= 0.85) if asks[at + r] not in told}
    return {"texts": n, "cells": len(index.cells.share), "near": len(want), "met": len(want & met), "recall": round(len(want & met) / max(1, len(want)), 4)}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="measure")
    p.add_argument("problem", choices=("p1", "p6"))
    p.add_argument("folder")
    p.add_argument("--shard", type=int, nargs="*", default=[vectors.SHARD_ROWS])
    a = p.parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    for rows in a.shard:
        vectors.SHARD_ROWS = rows
        if a.problem == "p1":
            for width in (8, 16, 48):
                history.ask_shards.__defaults__ = (history.FLOOR, width)
                print({"shard": rows, "beam": width, **recall_of_index(spark, table(spark, a.folder, "documents"))}, flush=True)
        else:
            print({"shard": rows, "partitions": parts(spark), **recall_of_ten(spark, table(spark, a.folder, "vchunks"))}, flush=True)


if __name__ == "__main__":
    main()
