"""Restartable ingest: a file source with Structured Streaming for what is new, a ledger for what has to be tried again.

Every file is judged by itself: one that can't be read is an error in the log, tried again by the next run, and given up as a
dead letter at its third error. What is taken in goes through the states staged, curated (its copy in the curated store has
the right digest) and indexed, each written to the ledger before the next step, so a run that ended anywhere is put right by
the next one. Commits append segments; only one writer works at a time.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import embed_text
from ..operators import ledger
from ..operators.audit import SECRET_NAMES, extraction_warnings, secret_reasons
from ..operators.segmentation import chunked
from ..runtime import cut, small
from ..sources.files import Snapshots, candidates, extracted, promote, promoted_names, verified_file

MANIFEST = "src string, action string, error string, attempt int, warnings array<string>, ts timestamp"
PENDING = "src_path string, rel_path string, dest_rel_path string, sha256 string, state string, error string, updated_at timestamp"


def incoming(spark: SparkSession, inbox: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, length, modificationTime, content) of new files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(per_batch)).load(inbox)
    )


def _relative(inbox: str):
    root = os.path.realpath(inbox)
    return F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.replace(".", "\\.") + "/", "")


def holds(folder: str | None):
    """An expression of (rel_path, sha256): whether the folder has a regular file of just that content."""

    @F.pandas_udf("boolean")
    def check(paths: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([bool(folder) and p is not None and d is not None and verified_file(os.path.join(folder, p), d) for p, d in zip(paths, digests)], dtype=bool)

    return check


def stands(folder: str):
    """An expression of rel_path: whether the folder has a regular file of that name."""

    @F.pandas_udf("boolean")
    def check(paths: pd.Series) -> pd.Series:
        full = [os.path.join(folder, p) if p is not None else "" for p in paths]
        return pd.Series([os.path.isfile(p) and not os.path.islink(p) for p in full], dtype=bool)

    return check


def logged(rows: DataFrame) -> DataFrame:
    """Rows of (src, action, ts) as those of the log."""
    return rows.select("src", "action", F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("array<string>").alias("warnings"), "ts")


def reextracted(spark: SparkSession, store: Snapshots, documents: DataFrame, curated: str, **extraction) -> dict:
    """Extracts documents (doc_id, src: their path in the curated store) again and puts new chunks in place of theirs, in one commit.

    Those whose copy is gone or whose text is too short stay as they are. Gives counts.
    """
    docs = store.read("documents")
    held = docs.join(documents.select("doc_id"), "doc_id", "left_semi").withColumn("path", F.concat(F.lit(os.path.realpath(curated) + "/"), "rel_path"))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(curated).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    found = held.join(content, "path").where(F.sha2("content", 256) == F.col("sha256"))
    texts = extracted(found.select("rel_path", "content"), **extraction).where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= ledger.LEAST_CHARS)
    new = cut(found.select("doc_id", "rel_path").join(texts, "rel_path").select("doc_id", "text", F.col("extractor").alias("new_extractor")))
    gone = small(new.select("doc_id"))
    chunks = cut(chunked(new).select(F.xxhash64("doc_id", "seq").alias("chunk_id"), F.col("doc_id").alias("document_id"), "seq", F.col("chunk").alias("text")))
    old = store.read("chunks")
    kept, lost = (old.join(gone.withColumnRenamed("doc_id", "document_id"), "document_id", how) for how in ("left_anti", "left_semi"))
    lost = small(cut(lost.select("chunk_id").distinct()))
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("new_n")).withColumnRenamed("document_id", "doc_id")
    changed = docs.join(counts.join(new.select("doc_id", "new_extractor"), "doc_id"), "doc_id", "left")
    changed = changed.withColumn("n_chunks", F.coalesce("new_n", "n_chunks")).withColumn("extractor", F.coalesce("new_extractor", "extractor")).select(docs.columns)
    vectors = store.read("vchunks").join(lost, "chunk_id", "left_anti").unionByName(chunks.select("chunk_id", embed_text(F.col("text")).alias("embedding")))
    store.commit(documents=changed, chunks=kept.unionByName(chunks.select(kept.columns)), vchunks=vectors)
    return {"asked": documents.count(), "done": new.count()}


def pending(store: Snapshots) -> DataFrame:
    """The last ledger row of each file."""
    rows = store.read("ingest_pending")
    if rows is None:
        return store.spark.createDataFrame([], PENDING)
    return ledger.latest(rows, "src_path", ["updated_at"]).select(*[c.split()[0] for c in PENDING.split(", ")])


def attempts(store: Snapshots) -> DataFrame:
    """(src, attempts, done) of the log."""
    log = store.read("manifest")
    if log is None:
        return store.spark.createDataFrame([], "src string, attempts long, done boolean")
    return ledger.attempts(log, "src", ["ts"])


def _ledger_rows(df: DataFrame, state: str, error=None) -> DataFrame:
    return df.select(
        F.col("rel_path").alias("src_path"), "rel_path", F.col("dest").alias("dest_rel_path"), "sha256", F.lit(state).alias("state"),
        (F.lit(None).cast("string") if error is None else error).alias("error"), F.current_timestamp().alias("updated_at"),
    )


def removed(store: Snapshots, doc_ids: DataFrame) -> None:
    """Takes documents out of the index, with their chunks and vectors, in one commit."""
    gone = small(cut(doc_ids.select("doc_id").distinct()))
    docs, chunks, vectors = (store.read(n) for n in ("documents", "chunks", "vchunks"))
    lost = small(cut(chunks.join(gone.withColumnRenamed("doc_id", "document_id"), "document_id", "left_semi").select("chunk_id").distinct()))
    store.commit(documents=docs.join(gone, "doc_id", "left_anti"), chunks=chunks.join(lost, "chunk_id", "left_anti"), vchunks=vectors.join(lost, "chunk_id", "left_anti"))


def ingest_batch(
    spark: SparkSession, files: DataFrame, store: Snapshots, inbox: str, domain: Callable[[DataFrame], DataFrame] | None = None, curated: str | None = None, quarantine: str | None = None,
    summary=None, dry_run: bool = False, clean: bool = False, **extraction,
) -> DataFrame:
    """Takes one batch of files (path, content) in: an outcome for each, then documents, chunks, vectors and the log in one commit.

    A file whose content is indexed already, also from the same batch, is a duplicate, if the curated copy of it is right; if
    that is missing or changed, what was indexed is removed and the file is taken in anew. So a batch that is replayed after a
    failure changes nothing. Without ``curated`` there are no copies to check. ``domain`` gives documents their domain,
    ``summary`` is an expression of their text. With ``clean``, files that are in the curated store or in quarantine by then leave
    the inbox, if they are still what was read. Gives (rel_path, action).
    """
    rows = cut(files.select(_relative(inbox).alias("rel_path"), "content", F.sha2("content", 256).alias("sha256")))
    texts = cut(extracted(rows, **extraction))
    first = rows.groupBy("sha256").agg(F.min("rel_path").alias("first"))
    judged = rows.drop("content").join(texts, "rel_path").join(first, "sha256")
    known = store.read("documents")
    if known is None:
        judged = judged.withColumn("known", F.lit(False))
    else:
        held = known.select("sha256", "doc_id", F.col("rel_path").alias("held_path")).join(small(cut(rows.select("sha256").distinct())), "sha256", "left_semi").dropDuplicates(["sha256"])
        held = cut(held.withColumn("right", holds(curated)(F.col("held_path"), F.col("sha256")) if curated else F.lit(True)))
        broken = held.where("not right").select("doc_id")
        if not dry_run and not broken.isEmpty():
            removed(store, broken)
        judged = judged.join(small(held.where("right").select("sha256", F.lit(True).alias("known"))), "sha256", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    before = attempts(store).select(F.col("src").alias("rel_path"), "attempts")
    judged = judged.join(before, "rel_path", "left").withColumn("attempt", (F.coalesce("attempts", F.lit(0)) + 1).cast("int"))
    action = ledger.outcome(F.lit(True), F.col("rel_path"), F.col("rel_path").rlike(SECRET_NAMES), F.col("known") | (F.col("rel_path") != F.col("first")), F.col("text"), F.size(secret_reasons(F.col("text"))) > 0, dry_run)
    failed = F.when(F.col("attempt") >= ledger.MAX_ATTEMPTS, "dead_letter").otherwise("error")
    judged = judged.withColumn("action", F.when(F.col("error").isNotNull() & ~F.col("known") & (F.col("rel_path") == F.col("first")), failed).otherwise(action))
    judged = cut(judged.withColumn("warnings", extraction_warnings(F.col("text"), F.col("extractor"), F.col("ocr_pages"))))
    told = judged.select("rel_path", "action")
    if dry_run:
        return told

    new = judged.where("action = 'processed'").withColumn("doc_id", F.xxhash64("sha256")).withColumn("domain", F.lit("99_MISC")).withColumn("source", F.regexp_extract("rel_path", "([^/]*)$", 1))
    new = new.withColumn("summary", summary if summary is not None else F.lit(None).cast("string"))
    if domain is not None:
        new = domain(new)
    named = promoted_names(new.withColumn("base", F.col("source")).withColumn("dir", F.concat_ws("/", "domain", F.nullif(F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1), F.lit("")))))
    new = cut(named.drop("base", "dir"))
    if curated:
        store.commit({"ingest_pending": _ledger_rows(new, "staged")})
        copied = cut(_copied(new.select("rel_path", "sha256", "dest").join(rows.select("rel_path", "content"), "rel_path"), curated))
        new = new.drop("dest").join(copied.where("error is null").select("rel_path", "dest"), "rel_path")
        store.commit({"ingest_pending": _ledger_rows(new, "curated").unionByName(_ledger_rows(copied.where("error is not null"), "staged", F.col("error")))})
        judged = judged.join(copied.where("error is not null").select("rel_path", F.col("error").alias("copy_error")), "rel_path", "left")
        judged = judged.withColumn("action", F.when(F.col("copy_error").isNotNull(), failed).otherwise(F.col("action"))).withColumn("error", F.coalesce("copy_error", "error"))
        told = judged.select("rel_path", "action")
    if quarantine:
        hidden = judged.where("action = 'quarantine_secret'").select("rel_path", "sha256", F.col("rel_path").alias("dest"))
        cut(_copied(hidden.join(rows.select("rel_path", "content"), "rel_path"), quarantine))

    chunks = cut(chunked(new).select(F.xxhash64("doc_id", "seq").alias("chunk_id"), F.col("doc_id").alias("document_id"), "seq", F.col("chunk").alias("text")))
    vectors = chunks.select("chunk_id", embed_text(F.col("text")).alias("embedding"))
    counts = chunks.groupBy("document_id").agg(F.count("*").cast("int").alias("n_chunks")).withColumnRenamed("document_id", "doc_id")
    path = F.col("dest") if curated else F.col("rel_path")
    docs = new.select("doc_id", "source", path.alias("rel_path"), "domain", "sha256", "extractor", "summary", F.current_timestamp().alias("ingested_at")).join(counts, "doc_id", "left")
    log = judged.select(F.col("rel_path").alias("src"), "action", "error", "attempt", "warnings", F.current_timestamp().alias("ts"))
    tables = {"documents": docs, "chunks": chunks, "vchunks": vectors, "manifest": log}
    if curated:
        tables["ingest_pending"] = _ledger_rows(new, "indexed").unionByName(_ledger_rows(judged.where("action = 'dead_letter'").withColumn("dest", F.lit(None).cast("string")), "dead_letter", F.col("error")))
    store.commit(tables)
    store.compact()
    if clean and curated:
        safe = ["processed", "skip_duplicate", *(["quarantine_secret"] if quarantine else [])]
        cut(_cleaned(judged.where(F.col("action").isin(safe)).select("rel_path", "sha256"), inbox))
    return told


def _cleaned(files: DataFrame, inbox: str) -> DataFrame:
    """(rel_path) of the files (rel_path, sha256) taken out of the inbox, which are still of that content."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            gone = [p for p, sha in zip(b.rel_path, b.sha256) if verified_file(os.path.join(inbox, p), sha)]
            for p in gone:
                os.remove(os.path.join(inbox, p))
            yield pd.DataFrame({"rel_path": gone})

    return files.mapInPandas(work, "rel_path string")


def _copied(files: DataFrame, folder: str) -> DataFrame:
    """(rel_path, sha256, dest, error): files (rel_path, sha256, dest, content) put below a folder that all executors share."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, sha, dest, content in zip(b.rel_path, b.sha256, b.dest, b.content):
                try:
                    out.append((path, sha, os.path.relpath(promote(bytes(content), os.path.join(folder, dest), sha), folder), None))
                except Exception as e:
                    out.append((path, sha, dest, str(e)[:500]))
            yield pd.DataFrame(out, columns=["rel_path", "sha256", "dest", "error"])

    return files.select("rel_path", "sha256", "dest", "content").mapInPandas(work, "rel_path string, sha256 string, dest string, error string")


def reconcile(store: Snapshots, inbox: str, curated: str) -> DataFrame:
    """Puts right what a run left half done, by the ledger's open rows; gives (rel_path) of the files to be tried again.

    What is indexed and curated is closed; what is indexed without a right copy is removed from the index; what has a right copy
    anywhere is tried again; the rest is a dead letter.
    """
    open_ = pending(store).where("state in ('staged', 'curated')")
    docs = store.read("documents")
    known = open_.withColumn("document", F.lit(False)).withColumn("doc_id", F.lit(None).cast("long")) if docs is None else open_.join(
        docs.select("sha256", "doc_id", F.lit(True).alias("document")).dropDuplicates(["sha256"]), "sha256", "left"
    ).withColumn("document", F.coalesce("document", F.lit(False)))
    facts = cut(known.withColumn("copy", holds(curated)(F.col("dest_rel_path"), F.col("sha256"))).withColumn("there", holds(inbox)(F.col("src_path"), F.col("sha256"))))
    decision, retry = ledger.reconciled(F.col("document"), F.col("copy"), F.col("there"))
    judged = cut(facts.withColumn("decision", decision).withColumn("retry", retry))
    if judged.isEmpty():
        return judged.select("rel_path")
    orphans = judged.where("document and not copy").select("doc_id")
    if not orphans.isEmpty():
        removed(store, orphans)
    rows = judged.withColumn("dest", F.col("dest_rel_path"))
    rows = rows.select("src_path", "rel_path", "dest_rel_path", "sha256", F.when(F.col("decision") == "reconciled", "indexed").otherwise(F.col("decision")).alias("state"), F.when(F.col("decision") == "dead_letter", "no valid copy in inbox or curated store").alias("error"), F.current_timestamp().alias("updated_at"))
    log = judged.where("decision in ('reconciled', 'dead_letter')").select(F.col("src_path").alias("src"), F.col("decision").alias("action"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("array<string>").alias("warnings"), F.current_timestamp().alias("ts"))
    store.commit({"ingest_pending": rows, "manifest": log})
    return judged.where("retry").select("rel_path")


def again(spark: SparkSession, store: Snapshots, inbox: str, retries: DataFrame | None = None) -> DataFrame | None:
    """(path, content) of the inbox's files that failed before or are open in the ledger, and aren't done; None if there are none."""
    log = attempts(store)
    failed = log.where("attempts > 0 and not done").select(F.col("src").alias("rel_path"))
    asked = store.read("manifest")
    if asked is not None:  # a dead letter that is asked for again has no attempts
        failed = failed.union(ledger.latest(asked, "src", ["ts"]).where("action = 'retry_requested'").select(F.col("src").alias("rel_path")))
    wanted = cut((failed if retries is None else failed.union(retries)).distinct())
    if wanted.isEmpty():
        return None
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(inbox).withColumn("rel_path", _relative(inbox))
    return candidates(held.join(small(wanted), "rel_path", "left_semi")).select("path", "content")


def run(spark: SparkSession, inbox: str, store_path: str, checkpoint: str, curated: str | None = None, **options) -> None:
    """Takes in all that is new or has to be tried again, and ends; run again, it goes on after what was committed."""
    store = Snapshots(spark, store_path)
    with store.writing():
        retries = reconcile(store, inbox, curated) if curated else None
        late = again(spark, store, inbox, retries)
        if late is not None:
            ingest_batch(spark, late, store, inbox, curated=curated, **options)
        query = (
            incoming(spark, inbox).writeStream.foreachBatch(lambda df, _: ingest_batch(spark, df, store, inbox, curated=curated, **options) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
