"""Problem 4: items that appear together.

Identical baskets are collapsed into one with a weight, so that the pairs of each distinct basket are enumerated once;
weights are summed per pair (partially before the shuffle). Large baskets are enumerated block by block.

Defined results: links with a null end are left out, repeated links count once, baskets of one item give no pair but
count in N and in the items' numbers; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.baskets import pair_counts, supported, weighted_baskets
from ..runtime import cut, small


def pairs(links: DataFrame, item: str = "equipment_id", basket: str = "document_id", least: int = 1, share: float = 0.0) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n): pairs in at least ``least`` baskets and at least ``share`` of all n baskets.

    Items below that support can be in no such pair and are left out before baskets are formed.
    """
    once = cut(links.select(F.col(item).alias("item"), F.col(basket).alias("basket")).dropna().distinct())
    n = once.select(F.countDistinct("basket")).first()[0]
    support = max(least, -int(-share * n * (1 - 1e-12) // 1))
    counts = cut(once.groupBy("item").agg(F.count("*").alias("c")).where(F.col("c") >= support))
    found = pair_counts(weighted_baskets(supported(once, counts, "item"), "item", "basket"), support).withColumnRenamed("n", "n_ab")
    counts = small(counts)
    side = lambda x: counts.select(F.col("item").alias(x), F.col("c").alias(f"n_{x}"))
    return found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_ab", "n_a", "n_b", F.lit(n).cast("long").alias("n"))


def _round(x: Column) -> Column:
    """To six decimals, as any engine with IEEE doubles does it."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def scored(links: DataFrame, **kw) -> DataFrame:
    """Pairs with lift and the conviction of a => b (null where the confidence is 1)."""
    p = pairs(links, **kw)
    confidence = F.col("n_ab") / F.col("n_a")
    return p.select(
        F.col("a").alias("equipment_id_a"),
        F.col("b").alias("equipment_id_b"),
        "n_ab",
        _round(F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"),
        _round(F.when(confidence < 1, (1 - F.col("n_b") / F.col("n")) / (1 - confidence))).alias("conviction"),
    )


def notable(links: DataFrame, least: int = 5, share: float = 0.002, lift: int = 4) -> DataFrame:
    """Pairs of enough support that come at least ``lift`` times as often as by chance."""
    p = pairs(links, least=least, share=share).where((F.col("n_ab") >= share * F.col("n") * (1 - 1e-12)) & (F.col("n_ab") * F.col("n") >= lift * F.col("n_a") * F.col("n_b")))
    return p.select(F.col("a").cast("long").alias("equipment_id_a"), F.col("b").cast("long").alias("equipment_id_b"))


SQL_PAIRS = """
WITH l AS (SELECT DISTINCT equipment_id AS item, document_id AS basket FROM doc_equipment WHERE equipment_id IS NOT NULL AND document_id IS NOT NULL),
n AS (SELECT count(DISTINCT basket) AS n FROM l),
c AS (SELECT item, count(*) AS c FROM l GROUP BY item),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS n_ab FROM l x JOIN l y ON x.basket = y.basket AND x.item < y.item GROUP BY ALL),
s AS (SELECT a, b, n_ab, ca.c AS n_a, cb.c AS n_b, n.n FROM p JOIN c ca ON ca.item = a JOIN c cb ON cb.item = b CROSS JOIN n)
"""
SQL_SCORED = SQL_PAIRS + """
SELECT a AS equipment_id_a, b AS equipment_id_b, n_ab,
  floor(n_ab::DOUBLE * n / (n_a::DOUBLE * n_b) * 1e6 + 0.5) / 1e6 AS lift,
  CASE WHEN n_ab < n_a THEN floor((1 - n_b::DOUBLE / n) / (1 - n_ab::DOUBLE / n_a) * 1e6 + 0.5) / 1e6 END AS conviction FROM s"""
SQL_FOUND = SQL_PAIRS + """
SELECT a AS equipment_id_a, b AS equipment_id_b FROM s WHERE n_ab >= 5 AND n_ab * 1000 >= 2 * n AND n_ab * n >= 4 * n_a * n_b"""
