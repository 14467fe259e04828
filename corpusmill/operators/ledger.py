"""The ingest ledger: logs of attempts, pending states, reconciliation and outcomes of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Actions after which a file is done, and extensions taken in.
TERMINAL = ["processed", "quarantine_secret", "skip_nondoc", "skip_empty", "skip_duplicate", "skip_gone"]
EXTENSIONS = ["pdf", "docx", "pptx", "xlsx", "xlsm", "txt", "md", "csv", "png", "jpg", "jpeg"]
STATES = ["staged", "curated", "indexed", "dead_letter"]
MAX_ATTEMPTS, LEAST_CHARS = 3, 20


def latest(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key, by the order columns. Aggregated partially, so a key of many records is no hot group."""
    rest = [c for c in log.columns if c != key]
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, *[f"r.{c}" for c in rest])


def dead_letters(log: DataFrame, key: str, order: list[str], action: str = "action") -> DataFrame:
    """Keys whose last record is a dead letter."""
    return latest(log, key, order).where(F.col(action) == "dead_letter")


def attempts(log: DataFrame, key: str, order: list[str], action: str = "action") -> DataFrame:
    """(key, attempts, done) folded from the log.

    A terminal action makes a key done; a retry request undoes that and starts its attempts anew; any other action is an
    attempt; three attempts make it done. Folded by two partial aggregations: the last reset of a key, then what came after.
    """
    at = F.struct(*order)
    rows = log.where(F.col(key).isNotNull()).select(key, F.coalesce(action, F.lit("")).alias("action"), at.alias("at"))
    reset = rows.where("action = 'retry_requested'").groupBy(key).agg(F.max("at").alias("reset"))
    after = (F.col("reset").isNull()) | (F.col("at") > F.col("reset"))
    terminal = F.col("action").isin(TERMINAL)
    counted = after & ~terminal & (F.col("action") != "retry_requested")
    folded = rows.join(reset, key, "left").groupBy(key).agg(F.count_if(counted).alias("attempts"), F.count_if(after & terminal).alias("ended"))
    return folded.select(key, "attempts", ((F.col("ended") > 0) | (F.col("attempts") >= MAX_ATTEMPTS)).alias("done"))


def requeued(queue: DataFrame, order: list[str], log: DataFrame | None = None) -> DataFrame:
    """src of the re-extraction queue's open requests: the last record of each source counts; what the log shows as processed since is closed."""
    last = latest(queue, "src", order).where(F.col("action") == "requested")
    if log is None:
        return last.select("src")
    done = log.where(F.col("action") == "processed").groupBy("src").agg(F.max("ts").alias("done"))
    return last.join(done, "src", "left").where(F.col("done").isNull() | (F.col("done") < F.col("ts"))).select("src")


def retry_requests(dead: DataFrame) -> DataFrame:
    """Log records that let dead letters be tried again."""
    return dead.select("src", F.lit("retry_requested").alias("action"), F.current_timestamp().alias("ts"))


def reconciled(document: Column, curated_ok: Column, source_ok: Column) -> tuple[Column, Column]:
    """(decision, retry) at start-up for a pending row: reconciled, curated, staged or dead_letter."""
    decision = F.when(document & curated_ok, "reconciled").when(curated_ok, "curated").when(source_ok, "staged").otherwise("dead_letter")
    return decision, ~(document & curated_ok) & (curated_ok | source_ok)


def outcome(safe: Column, path: Column, secret_name: Column, duplicate: Column, text: Column, secret_text: Column, dry_run: bool = False) -> Column:
    """What becomes of a file, by the first rule that holds."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]*)$", 1))
    base = F.regexp_extract(path, "([^/]*)$", 1)
    document = ext.isin(EXTENSIONS) & ~base.startswith("~$") & ~base.startswith(".")
    quarantine = F.lit("would_quarantine" if dry_run else "quarantine_secret")
    return (
        F.when(~safe, "skip_unsafe").when(~document, "skip_nondoc").when(secret_name, quarantine).when(duplicate, "skip_duplicate")
        .when(F.length(T.strip(F.coalesce(text, F.lit("")))) < LEAST_CHARS, "skip_empty").when(secret_text, quarantine).otherwise("would_ingest" if dry_run else "processed")
    )


def valid_states(pending: DataFrame) -> DataFrame:
    """Rows whose state is one of the four known ones."""
    return pending.where(F.col("state").isin(STATES))
