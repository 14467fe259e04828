"""Citations, degraded answers and the states of an answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def cited(answer: Column) -> Column:
    """Numbers in square brackets, in order, repeated ones too; numbers past any list are -1."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("\\[(\\d+)\\]"), F.lit(1))
    return F.transform(found, lambda x: F.when(F.length(x) <= 9, x.try_cast("int")).otherwise(F.lit(-1)))


def citations(answer: Column, sources: Column) -> Column:
    """struct(numbers, valid, invalid, present, all_valid) for an answer over ``sources`` numbered passages."""
    n = cited(answer)
    good = lambda x: (x >= 1) & (x <= sources)
    return F.struct(
        n.alias("numbers"), F.filter(n, good).alias("valid"), F.filter(n, lambda x: ~good(x)).alias("invalid"), (F.size(n) > 0).alias("present"), ((F.size(n) > 0) & F.forall(n, good)).alias("all_valid")
    )


def scrubbed(answer: Column, sources: Column) -> Column:
    """The answer with invalid citations replaced."""
    bad = F.array_distinct(F.filter(cited(answer), lambda x: (x < 1) | (x > sources)))
    return F.aggregate(bad, answer, lambda a, x: F.replace(a, F.concat(F.lit("["), x.cast("string"), F.lit("]")), F.lit("[invalid citation removed]")))


def excerpts(hits: Column, most: int = 5, chars: int = 320) -> Column:
    """The degraded answer: ``[i] source — excerpt`` of the first hits (an array of structs with source and text)."""
    one = lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["source"], F.lit(" — "), F.substring(T.strip(F.regexp_replace(h["text"], "\\s+", " ")), 1, chars))
    return F.array_join(F.transform(F.slice(hits, 1, most), one), "\n")


def context(hits: Column) -> Column:
    """The passages for a prompt: numbered blocks with source and domain, parted by blank lines."""
    one = lambda h, i: F.concat(F.lit('<source id="'), (i + 1).cast("string"), F.lit('" name="'), h["source"], F.lit('" domain="'), F.coalesce(h["domain"], F.lit("")), F.lit('">\n'), h["text"], F.lit("\n</source>"))
    return F.array_join(F.transform(hits, one), "\n\n")


def state(error: Column, sources: Column, answer: Column) -> Column:
    """retrieval_error, no_relevant, degraded (no answer or no valid citation), partial (some invalid) or grounded."""
    c = citations(answer, sources)
    return (
        F.when(error.isNotNull(), "retrieval_error").when(sources == 0, "no_relevant").when(T.strip(F.coalesce(answer, F.lit(""))) == "", "degraded")
        .when(F.size(c["valid"]) == 0, "degraded").when(F.size(c["invalid"]) > 0, "partial").otherwise("grounded")
    )
