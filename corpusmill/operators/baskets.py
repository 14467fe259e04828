"""Pairs of items that share baskets, counted without a self-join on the basket.

Identical item arrays are collapsed into one with a weight, so that the pairs of each distinct basket are enumerated once.
Large baskets are cut into blocks of BLOCK items, and each two blocks of a basket are enumerated apart, so that no task holds
the pairs of one basket and no more than two blocks travel together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, parts, small

#: Items of one block. It changes no result.
BLOCK = 256
#: An item of more links is joined apart from the others; there are no more of them than links / HOT.
HOT = 100_000


def supported(links: DataFrame, counts: DataFrame, item: str) -> DataFrame:
    """The links of the counted items; counts: (item, c). Where they are too many to be sent everywhere, those of many links are."""
    hinted = small(counts)
    if hinted is not counts:
        return links.join(hinted.select(item), item, "left_semi")
    many = F.broadcast(counts.where(F.col("c") > HOT).select(item))
    rest = links.join(many, item, "left_anti").join(counts.where(F.col("c") <= HOT).select(item), item, "left_semi")
    return links.join(many, item, "left_semi").unionByName(rest)


def weighted_baskets(links: DataFrame, item: str, basket: str) -> DataFrame:
    """(items, w): each distinct sorted array of two items or more, and how many baskets hold just it; links are distinct."""
    arrays = links.groupBy(basket).agg(F.array_sort(F.collect_list(item)).alias("items")).where(F.size("items") > 1)
    return arrays.groupBy("items").agg(F.count("*").alias("w"))


def pair_counts(weighted: DataFrame, least: int = 1) -> DataFrame:
    """(a, b, n), a < b: the summed weights of the baskets that hold both, of at least ``least``."""
    baskets = cut(weighted)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / BLOCK).cast("int")), lambda k: F.slice("items", k * BLOCK + 1, BLOCK))
    large = baskets.where(F.size("items") > BLOCK).select("w", blocks.alias("blocks"))
    two = large.select("w", "blocks", F.posexplode("blocks").alias("x", "left")).select("w", "x", "left", F.posexplode("blocks").alias("y", "right")).where("x < y").drop("x", "y")
    one = large.select("w", F.explode("blocks").alias("items"))
    spread = parts(weighted.sparkSession)
    within = baskets.where(F.size("items") <= BLOCK).select("w", "items").unionByName(one.repartition(spread))
    near = within.select("w", "items", F.posexplode("items").alias("i", "a")).select("w", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    apart = two.repartition(spread).select("w", F.explode("left").alias("a"), "right").select("w", "a", F.explode("right").alias("b"))
    return near.unionByName(apart).groupBy("a", "b").agg(F.sum("w").alias("n")).where(F.col("n") >= least)
