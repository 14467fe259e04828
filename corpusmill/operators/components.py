"""Connected components by alternating large-star and small-star rounds.

Every round is one aggregation and one equi-join on the node; no neighbourhood is ever gathered into a group, so hubs are
harmless (a skewed join key is split by AQE). Rounds grow with the logarithm of the longest path. Lineage is cut by a
written table after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, dispose


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge; the component is its least id.

    Null ends, loops and repeated edges are ignored; no edges give no rows.
    """
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    now = cut(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    for _ in range(max_rounds):
        before = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not before[0]:
            break
        big = _star(now, True)
        last, now = now, cut(_star(big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        dispose(last)
        if now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    return labels.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
