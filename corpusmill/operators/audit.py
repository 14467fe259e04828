"""Gates, statistics and consistency checks over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Patterns of secrets; our own set.
SECRETS = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "password": "(?i)\\bpassw(?:or)?d\\s*[=:]\\s*[\"']?[^\\s\"']{6,}",
    "api_key": "(?i)\\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|token)\\s*[=:]\\s*[\"']?[A-Za-z0-9_\\-./+]{16,}",
    "cloud_key": "\\bAKIA[0-9A-Z]{16}\\b",
}
SECRET_NAMES = "(?i)(?:^|/)(?:id_rsa|id_ed25519|\\.env|[^/]*\\.(?:pem|key|p12|pfx)|credentials(?:\\.[a-z]+)?)$"


def secret_reasons(text: Column) -> Column:
    """Names of the patterns found; the whole text is searched. Null text has none."""
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRETS.items()]))
    return F.coalesce(found, F.array().cast("array<string>"))


def domain_stats(documents: DataFrame) -> DataFrame:
    """(domain, documents, chunks)."""
    return documents.groupBy("domain").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"))


def zero_filled(documents: DataFrame, taxonomy: list[str]) -> DataFrame:
    """(domain, documents): every domain of the taxonomy, with 0 where there is none, then the others."""
    spark = documents.sparkSession
    counts = documents.where("domain is not null").groupBy("domain").agg(F.count("*").alias("documents"))
    known = spark.createDataFrame([(t,) for t in taxonomy], "domain string")
    return known.join(counts, "domain", "full").select("domain", F.coalesce("documents", F.lit(0)).alias("documents"))


def totals(documents: DataFrame, chunks: DataFrame, equipment: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(documents, "documents").join(F.broadcast(n(chunks, "chunks"))).join(F.broadcast(n(equipment, "equipment")))


def degenerate(text: Column) -> Column:
    """Fewer than 10 characters, a vocabulary under 0.12 of 20 words or more, or a character more than 20 times in a row."""
    s = T.strip(text)
    w = F.regexp_extract_all(F.lower(s), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    return (F.length(s) < 10) | ((F.size(w) >= 20) & (F.size(F.array_distinct(w)) / F.size(w) < 0.12)) | s.rlike("(.)\\1{20,}")


def extraction_warnings(text: Column, extractor: Column, ocr_pages: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(
        F.array(
            F.when(low.contains("ocr limited to first"), F.lit("ocr_page_limit")),
            F.when(low.contains("[ocr error on page"), F.lit("ocr_page_error")),
            F.when(low.contains("rows truncated"), F.lit("row_limit")),
            F.when((extractor == "ocr") & (ocr_pages == 0), F.lit("ocr_no_pages")),
        )
    )


def chars_of(chunks: DataFrame) -> DataFrame:
    """(document_id, chars) over its chunks, each once."""
    return chunks.dropDuplicates(["chunk_id"]).groupBy("document_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def thin(documents: DataFrame, chunks: DataFrame, least: int = 800) -> DataFrame:
    """(doc_id, chars) of scans and pictures with little text; documents without chunks have 0."""
    pictures = documents.where(F.lower(F.regexp_extract("rel_path", "\\.([^./]*)$", 1)).isin("pdf", "png", "jpg", "jpeg"))
    j = pictures.select("doc_id").join(chars_of(chunks).withColumnRenamed("document_id", "doc_id"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("chars", F.lit(0)).alias("chars")).where(F.col("chars") < least)


def thinnest(documents: DataFrame, chunks: DataFrame, there: Column | None = None, least: int = 800, limit: int | None = None) -> DataFrame:
    """``thin`` with rel_path, in order of length, of the files that are ``there`` (an expression of the document); the first ``limit`` where that is told."""
    held = documents.join(thin(documents, chunks, least), "doc_id")
    held = (held if there is None else held.where(there)).select("doc_id", "rel_path", "chars").orderBy("chars", "doc_id")
    return held if limit is None else held.limit(limit)


def copies_state(documents: DataFrame, present: Column, right: Column) -> DataFrame:
    """(doc_id, rel_path, state): missing, changed or ok, of the curated copy of each document; present and right are expressions of it."""
    return documents.select("doc_id", "rel_path", F.when(~present, "missing").when(~right, "changed").otherwise("ok").alias("state"))


def gain(old: Column, new: Column, failed: Column, swap_failed: Column, dry_run: bool = False, margin: int = 200) -> Column:
    """Whether a new description is taken."""
    enough = new > old + margin
    return F.when(failed, "describe_error").when(~enough, "no_gain").when(F.lit(dry_run), "would_describe").when(swap_failed, "swap_error").otherwise("described")


def unprocessed(documents: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id with chunks and without entities."""
    d = documents.select(F.col("doc_id").alias("document_id"))
    return d.join(chunks, "document_id", "left_semi").join(entities, "document_id", "left_anti").select(F.col("document_id").alias("doc_id"))


def entity_input(documents: DataFrame, chunks: DataFrame, first: int = 3, most: int = 2600, least: int = 40) -> DataFrame:
    """(doc_id, input): summary and first three chunks, cut; short ones are left out."""
    heads = chunks.dropDuplicates(["chunk_id"]).where((F.col("seq") < first) & F.col("text").isNotNull())
    texts = heads.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "text"))), lambda x: x["text"]).alias("t"))
    j = documents.join(texts.withColumnRenamed("document_id", "doc_id"), "doc_id")
    text = F.substring(F.array_join(F.concat(F.array(F.coalesce("summary", F.lit(""))), F.slice("t", 1, first)), "\n"), 1, most)
    return j.select("doc_id", text.alias("input")).where(F.length(T.strip(F.col("input"))) >= least)


def consistency(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: counts of documents, chunks, vectors, documents whose n_chunks is wrong, pending and dead rows, and drift.

    Rows delivered twice count once; pending is taken by the last state of each record.
    """
    once = chunks.select("chunk_id", "document_id").dropDuplicates(["chunk_id"])
    actual = once.groupBy("document_id").agg(F.count("*").alias("actual")).withColumnRenamed("document_id", "doc_id")
    wrong = documents.join(actual, "doc_id", "left").where(F.coalesce("actual", F.lit(0)) != F.coalesce("n_chunks", F.lit(-1)))
    count = lambda df, c: F.broadcast(df.agg(F.count("*").alias(c)))
    v = vectors.select("chunk_id").distinct()
    states = pending.select("pending_id", "state").distinct()
    dead = states.where("state = 'dead_letter'").select("pending_id").distinct()
    live = states.select("pending_id").distinct().join(dead, "pending_id", "left_anti")
    row = count(documents, "documents").join(count(once, "chunks")).join(count(v, "vectors")).join(count(wrong, "chunk_mismatches")).join(count(live, "pending")).join(count(dead, "dead_letters"))
    drift = F.col("chunks") != F.col("vectors")
    return row.withColumn("index_drift", drift).withColumn("ok", ~drift & (F.col("chunk_mismatches") == 0) & (F.col("pending") == 0))


def stale(documents: DataFrame, now: str, days: int = 365) -> DataFrame:
    """(doc_id, rel_path) taken in at least max(1, days) days before ``now``; without a time they aren't stale."""
    age = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(max(1, days)))
    return documents.where(F.col("ingested_at") <= age).select("doc_id", "rel_path")


def dpi(width_in: Column, height_in: Column, wanted: int = 200, cap: int = 20_000_000) -> Column:
    """Resolution at which a page stays under the cap of pixels, at least 50."""
    px = width_in * wanted * height_in * wanted
    return F.when(px > cap, F.greatest(F.lit(50), F.floor(wanted * F.sqrt(cap / px) * 0.95).cast("int"))).otherwise(F.lit(wanted))


def content_signature(df: DataFrame) -> DataFrame:
    """(rows, signature): independent of order and partitioning; equal for equal contents."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in sorted(df.columns)]
    h = F.sha2(F.concat_ws("\x1f", *cols), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return df.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *parts), 256).alias("signature"))
