"""Retrieval and answer metrics over a gold set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .answers import cited

#: Words of a refusal, and categories of failure.
REFUSALS = ["cannot find", "could not find", "not found", "no relevant", "insufficient information", "retrieval failed", "generation failed", "embedding failed", "unavailable", "offline"]
FAILURES = ["kb_failure", "model_failure", "embedding_failure"]


def ranks(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(gold_id, rank): of each item with an expected source the rank of the first hit whose source contains it, null for a miss.

    hits: (gold_id, rank, source).
    """
    asked = gold.where(F.coalesce("expect_source", F.lit("")) != "").select("gold_id", F.lower("expect_source").alias("want"))
    j = asked.join(hits.select("gold_id", "rank", F.lower(F.coalesce("source", F.lit(""))).alias("have")), "gold_id", "left")
    return j.groupBy("gold_id").agg(F.min(F.when(F.col("have").contains(F.col("want")), F.col("rank"))).alias("rank"))


def retrieval_metrics(found: DataFrame) -> DataFrame:
    """(questions, recall, mrr); null rates without questions, misses count 0."""
    n = F.count("*")
    return found.agg(n.alias("questions"), F.round(F.count("rank") / F.nullif(n, F.lit(0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def fold(text: Column) -> Column:
    """Dashes and quotes in their ASCII forms, then NFKC; null is empty."""
    return T.nfkc(T.ascii_punctuation(F.coalesce(text, F.lit(""))))


def supported(answer: Column, passages: Column, facts: Column) -> Column:
    """Every fact is in a cited passage; false without citations or facts. passages: texts in citation order."""
    inside = F.transform(F.filter(cited(answer), lambda n: (n >= 1) & (n <= F.size(passages))), lambda n: F.lower(fold(F.element_at(passages, n))))
    folded = F.transform(facts, lambda f: F.lower(fold(f)))
    return F.coalesce((F.size(inside) > 0) & (F.size(facts) > 0) & F.forall(folded, lambda f: F.exists(inside, lambda p: p.contains(f))), F.lit(False))


def refusal(answer: Column, sources: Column) -> Column:
    """No sources and a word of refusal."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    said = F.lit(False)
    for m in REFUSALS:
        said = said | low.contains(m)
    return (sources == 0) & said


def answer_metrics(rows: DataFrame) -> DataFrame:
    """(metric, hits, total, rate) of (category, expected_behaviour, expect_citations, expected_facts, answer, sources, passages)."""
    n = cited(F.col("answer"))
    good = (F.size(n) > 0) & F.forall(n, lambda x: (x >= 1) & (x <= F.col("sources")))
    facts = F.coalesce(F.size("expected_facts"), F.lit(0)) > 0
    low = F.lower(fold(F.col("answer")))
    right = F.forall("expected_facts", lambda f: low.contains(F.lower(fold(f))))
    refused = refusal(F.col("answer"), F.col("sources"))
    failing = F.col("category").isin(FAILURES)
    cases = [
        ("citation_presence", F.col("expect_citations"), F.size(n) > 0),
        ("citation_validity", F.col("expect_citations"), good),
        ("citation_support", facts, supported(F.col("answer"), F.col("passages"), F.col("expected_facts"))),
        ("known_answer_correctness", facts, right),
        ("refusal_quality", F.col("expected_behaviour") == "refuse", refused),
        ("failure_behaviour", failing, (F.col("expected_behaviour") == "degraded") & refused),
    ]
    told = rows.select(*[x for name, of, hit in cases for x in ((of & hit).alias(f"{name}_h"), of.alias(f"{name}_t"))])
    sums = told.agg(*[F.count_if(F.col(f"{name}_{end}")).alias(f"{name}_{end}") for name, _, _ in cases for end in "ht"])
    out = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_h").alias("hits"), F.col(f"{name}_t").alias("total")) for name, _, _ in cases]))
    return sums.select(out.alias("m")).select("m.*").withColumn("rate", F.round(F.col("hits") / F.nullif("total", F.lit(0)), 6))


def contract(gold: DataFrame) -> DataFrame:
    """(gold_id, reasons): why an item breaks the contract; an empty array if it doesn't. Nothing is raised."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    failing = F.col("category").isin([*FAILURES, "missing_information"])
    facts = F.coalesce("expected_facts", F.array().cast("array<string>"))
    answerable = ~failing
    reasons = F.array_compact(
        F.array(
            F.when(blank("gold_id") | blank("category") | blank("q"), F.lit("id, category and q must be non-empty")),
            F.when(F.col("expect_citations").isNull(), F.lit("expect_citations must be boolean")),
            F.when(failing & ~F.coalesce("expected_behaviour", F.lit("")).isin("refuse", "degraded"), F.lit("must expect refuse or degraded")),
            F.when(answerable & ((F.coalesce("expected_behaviour", F.lit("")) != "answer") | blank("expect_source") | (F.size(facts) == 0)), F.lit("answerable item needs answer, source and facts")),
            F.when(answerable & F.exists(facts, lambda f: F.trim(F.coalesce(f, F.lit(""))) == ""), F.lit("facts must be non-empty")),
        )
    )
    return gold.select("gold_id", reasons.alias("reasons"))
