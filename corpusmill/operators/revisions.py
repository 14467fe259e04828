"""Families of revisions, told from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import small

#: The marks of a revision, in order of priority, as (kind, pattern).
LETTER = "(?i)(?<![A-Za-z])rev[\\s._-]*([A-Za-z])(\\d*)\\b"
NUMBER = "(?i)(?<![A-Za-z])rev[\\s._-]*(\\d+)\\b"
VERSION = "(?i)(?<![A-Za-z])v\\.?\\s*(\\d+)\\.(\\d+)\\b"
DAY = "\\b(\\d{2})[-_.](\\d{2})[-_.](20\\d{2})\\b"
DAY8 = "\\b(20\\d{6})\\b"
COPY = "\\((\\d+)\\)"
MARKS = [LETTER, NUMBER, VERSION, DAY, DAY8, COPY]
LEAST_STEM, LEAST_CHARS, LEAST_SIMILARITY = 6, 300, 0.20


def revision(name: Column) -> Column:
    """struct(kind, sortkey array<bigint>, label) of the first mark in the name, null without one."""
    g = lambda p, i: F.regexp_extract(name, p, i)
    n = lambda p, i: F.when(g(p, i) == "", F.lit(0)).otherwise(g(p, i)).cast("bigint")
    keys = [
        ("rev-letter", F.array(F.ascii(F.upper(g(LETTER, 1))).cast("bigint"), n(LETTER, 2)), F.concat(F.lit("rev"), g(LETTER, 1), g(LETTER, 2))),
        ("rev-num", F.array(n(NUMBER, 1)), F.concat(F.lit("rev"), g(NUMBER, 1))),
        ("version", F.array(n(VERSION, 1), n(VERSION, 2)), F.concat(F.lit("v"), g(VERSION, 1), F.lit("."), g(VERSION, 2))),
        ("date", F.array(F.concat(g(DAY, 3), g(DAY, 2), g(DAY, 1)).cast("bigint")), F.concat_ws("-", g(DAY, 1), g(DAY, 2), g(DAY, 3))),
        ("date", F.array(n(DAY8, 1)), g(DAY8, 1)),
        ("copy", F.array(n(COPY, 1)), F.regexp_extract(name, "\\(\\d+\\)", 0)),
    ]
    out = F.lit(None).cast("struct<kind:string,sortkey:array<bigint>,label:string>")
    for pattern, (kind, key, label) in reversed(list(zip(MARKS, keys))):
        out = F.when(name.rlike(pattern), F.struct(F.lit(kind).alias("kind"), key.alias("sortkey"), label.alias("label"))).otherwise(out)
    return out


def stem(name: Column) -> Column:
    """The name without extension and marks, in lower case with single spaces."""
    s = F.regexp_replace(name, "(?<=[^.])\\.[^.]*$", "")
    for p in MARKS:
        s = F.regexp_replace(s, p, " ")
    return F.lower(F.trim(F.regexp_replace(s, "[ _.\\-]+", " ")))


def parsed(documents: DataFrame) -> DataFrame:
    """documents with base, ext, parent, rev and stem; rows without a mark or with a short stem are left out."""
    base = F.regexp_extract("rel_path", "([^/]*)$", 1)
    out = documents.where("rel_path is not null").withColumn("base", base)
    out = out.withColumn("ext", F.lower(F.regexp_extract("base", "[^.](\\.[^.]*)$", 1))).withColumn("parent", F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1))
    return out.withColumn("rev", revision(F.col("base"))).withColumn("stem", stem(F.col("base"))).where(F.col("rev").isNotNull() & (F.length("stem") >= LEAST_STEM))


def families(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per member of a family: (domain, parent, stem, ext, kind, doc_id, rel_path, label, verdict).

    verdict is keep (the highest mark; ties by rel_path and doc_id), supersede or held (an equal mark, or more than twice the
    chunks of the kept one). Members whose words are unlike the kept one's, both having 300 characters, are left out, and
    with them families of which only the kept one is left. texts: (doc_id, text).
    """
    key = ["domain", "parent", "stem", "ext", "kind"]
    words = texts.select("doc_id", T.normalised(F.col("text")).alias("norm"))
    rows = parsed(documents).select("doc_id", "rel_path", F.coalesce("domain", F.lit("")).alias("domain"), "parent", "stem", "ext", "rev.*", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    order = Window.partitionBy(*key).orderBy(F.desc("sortkey"), "rel_path", "doc_id")
    ranked = rows.withColumn("place", F.row_number().over(order)).withColumn("size", F.count("*").over(Window.partitionBy(*key))).where("size > 1").drop("size")
    # only the words of family members are compared, each with the kept member's
    full = ranked.join(words, "doc_id", "left").withColumn("norm", F.coalesce("norm", F.lit("")))
    kept = full.where("place = 1").select(*key, F.col("sortkey").alias("k_key"), F.col("n_chunks").alias("k_chunks"), F.col("norm").alias("k_norm"))
    j = full.join(kept, key)
    a, b = F.array_distinct(F.split("norm", " ")), F.array_distinct(F.split("k_norm", " "))
    unlike = (F.length("norm") >= LEAST_CHARS) & (F.length("k_norm") >= LEAST_CHARS) & (F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) < LEAST_SIMILARITY)
    verdict = (
        F.when(F.col("place") == 1, "keep").when(F.col("sortkey") == F.col("k_key"), "held").when(F.col("n_chunks") > 2 * F.greatest(F.lit(1), F.col("k_chunks")), "held").otherwise("supersede")
    )
    judged = j.where((F.col("place") == 1) | ~unlike).select(*key, "doc_id", "rel_path", "label", verdict.alias("verdict"))
    comparable = F.sum(F.when(F.col("verdict") != "keep", 1).otherwise(0)).over(Window.partitionBy(*key))
    return judged.withColumn("others", comparable).where("others > 0").drop("others")


def superseded(family: DataFrame, already: DataFrame) -> DataFrame:
    """rel_path of the superseded members that aren't on the exclusion list yet."""
    return family.where("verdict = 'supersede'").select("rel_path").distinct().join(small(already.select("rel_path").distinct()), "rel_path", "left_anti")
