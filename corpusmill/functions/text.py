"""Text expressions evaluated on the JVM. Nulls in give nulls out unless stated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines are parted by these characters.
LINE_BREAKS = "\\n\\r\\x0B\\x0C\\x85\\u2028\\u2029"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often, and in whatever inner function, the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfkc(text: Column) -> Column:
    """Unicode NFKC, by the ICU library that ships with Spark; ASCII text is passed through."""
    plain = text.rlike("^[\\x00-\\x7F]*$")
    return F.when(plain, text).when(
        text.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    )


def folded(text: Column) -> Column:
    """NFKC and lower case."""
    return F.lower(nfkc(text))


def words(text: Column) -> Column:
    """The longest runs of letters and digits after NFKC and lower-casing."""
    return F.regexp_extract_all(folded(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def word_hashes(text: Column) -> Column:
    """One 64-bit hash per word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "^[\\t\\n\\x0B\\f\\r\\p{Z}]+|[\\t\\n\\x0B\\f\\r\\p{Z}]+$", "")


def normalised(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, joined by single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def hash32(text: Column) -> Column:
    """32-bit hash as a long: the first eight hex digits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


#: Dashes and quotes with their ASCII forms, and the letters that lose a diacritic.
DASHES = "‐‑‒–—"
QUOTES = "‘’“”"
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def ascii_punctuation(text: Column) -> Column:
    """Dashes and quotes in their ASCII forms."""
    return F.translate(text, DASHES + QUOTES, "-" * len(DASHES) + "''\"\"")


def without_accents(text: Column) -> Column:
    """Lower-case Latin letters without their diacritics."""
    return F.translate(text, ACCENTED, PLAIN)


def lexical_terms(text: Column) -> Column:
    """Index terms: lower case, no diacritics, runs of letters and digits."""
    return F.regexp_extract_all(without_accents(F.lower(text)), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
