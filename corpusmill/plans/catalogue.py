"""Every operator as a query over the test tables, with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, audit, dedupe, entities, evaluation, ledger, retrieval, revisions, segmentation
from ..runtime import cut, once, spread, table, together
from ..sources import files
from . import oracle

TAXONOMY = oracle.TAXONOMY


def _docs(s, d):
    return table(s, d, "documents")


def _texts(s, d):
    """(doc_id, text), over all cores."""
    return spread(_docs(s, d).select("doc_id", "text"))


def _chunks(s, d):
    return spread(table(s, d, "chunks").select("chunk_id", "document_id", "seq", "text"))


def _usable(s, d):
    """(chunk_id, vector) of vectors of full length, each chunk once."""
    v = spread(table(s, d, "vchunks")).where("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x))")
    return cut(once(v.select("chunk_id", F.col("embedding").alias("vector")), "chunk_id"))


def _gold_queries(s, d):
    return table(s, d, "gold").select(F.col("gold_id").alias("query_id"), F.col("q").alias("text")).where("text is not null")


def _items(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _stated(df):
    """The stated queries: every row whose id is divisible by 20."""
    return df.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def _links(s, d):
    return table(s, d, "doc_equipment")


def domain_zero_fill(s, d):
    return audit.zero_filled(_docs(s, d), TAXONOMY)


def chunk_windows(s, d):
    return segmentation.chunked(_texts(s, d).where("text is not null"), by=segmentation.windows)


def source_reassembly(s, d):
    t = segmentation.reassembled(_chunks(s, d))
    return t.select("document_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


def normalised_text(s, d):
    t = _texts(s, d).where("text is not null").select("doc_id", T.normalised(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def shingle_counts(s, d):
    t = _texts(s, d).where("text is not null").select("doc_id", F.size(segmentation.shingles(T.normalised(F.col("text")))).alias("n"))
    return t


def minhash_signatures(s, d):
    return dedupe.signatures(_texts(s, d)).select("doc_id", F.md5(F.array_join("sig", ",")).alias("digest"))


def lsh_pairs(s, d):
    return dedupe.near_pairs(dedupe.signatures(_texts(s, d)))


def revision_parse(s, d):
    p = revisions.parsed(_docs(s, d))
    return p.select("doc_id", "stem", "ext", "parent", F.col("rev.kind").alias("kind"), F.col("rev.label").alias("label"), F.get("rev.sortkey", F.lit(0)).alias("key1"), F.get("rev.sortkey", F.lit(1)).alias("key2"))


def revision_families(s, d):
    return revisions.families(_docs(s, d), _docs(s, d).select("doc_id", "text")).select("doc_id", "stem", "kind", "label", "verdict")


def superseded_paths(s, d):
    fam = revisions.families(_docs(s, d), _docs(s, d).select("doc_id", "text"))
    already = _docs(s, d).where("doc_id % 3 = 0").select("rel_path")  # a list made before
    return revisions.superseded(fam, already)


def bm25_topk(s, d):
    hits = retrieval.bm25(_gold_queries(s, d), _chunks(s, d), 10)
    c = table(s, d, "chunks").select("chunk_id", "document_id").dropDuplicates(["chunk_id"])
    return hits.join(c, "chunk_id").select("query_id", "chunk_id", "document_id", "score", "rank")


def knn_l2_topk(s, d):
    v = _items(s, d)
    return retrieval.nearest(_stated(v), v.select("chunk_id", "vector"), 10)


def knn_eligible(s, d):
    v = _items(s, d)
    return retrieval.eligible_arm(_stated(v), v.select("chunk_id", "vector"), v.where("label < 7").select("chunk_id"), 8)


def _hybrid_inputs(s, d):
    c, v = _chunks(s, d), _usable(s, d)
    told = _docs(s, d).where("summary is not null").select(F.col("doc_id").alias("document_id"), F.col("summary").alias("text"))  # a query has the whole summary as its text
    q = c.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "document_id").dropDuplicates(["query_id"]).join(told, "document_id").drop("document_id").join(v.withColumnRenamed("chunk_id", "query_id"), "query_id")
    q = cut(q)
    ok = retrieval.eligible_chunks(c, _docs(s, d), ["10_power", "20_cooling", "30_water"])
    return q, c, v, ok


def hybrid_search(s, d):
    q, c, v, ok = _hybrid_inputs(s, d)
    return retrieval.hybrid(q, c, v, 8, eligible=ok)


def rrf_fusion(s, d):
    q, c, v, _ = _hybrid_inputs(s, d)
    arm, lex = together(lambda: retrieval.nearest(q.select("query_id", "vector"), v, 20), lambda: retrieval.bm25(q.select("query_id", "text"), c, 20))
    arm, lex = (x.withColumn("pos", F.col("rank") - 1) for x in (arm, lex))
    return retrieval.fuse(arm, lex).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "vec_pos", "lex_pos")


def entity_boost(s, d):
    q = table(s, d, "chunks").dropDuplicates(["chunk_id"]).where("chunk_id % 20 = 0 and text is not null").select(F.col("chunk_id").alias("query_id"), "text")
    q = q.unionByName(_named_queries(s, d))
    found = retrieval.boosted_documents(q, retrieval.aliases(table(s, d, "equipment"), _links(s, d)))
    return found.groupBy("query_id").agg(F.count("*").alias("documents"), F.min("document_id").alias("least"))


def boosted_fusion(s, d):
    """The lexical arm of each item's question, fused and boosted by the documents linked to the items it names."""
    q, c = _named_queries(s, d), _chunks(s, d)
    lex = retrieval.bm25(q, c, 20).withColumn("pos", F.col("rank") - 1)
    fused = retrieval.fuse(lex.limit(0), lex)
    boosted = retrieval.boosted_documents(q, retrieval.aliases(table(s, d, "equipment"), _links(s, d)))
    return retrieval.ordered(retrieval.boost(fused, c, boosted, 0.012), 8).select("query_id", "chunk_id", "score", "rank")


def hit_metadata(s, d):
    hits = retrieval.bm25(_gold_queries(s, d), _chunks(s, d), 5)
    return retrieval.hydrated(hits, table(s, d, "chunks"), _docs(s, d)).select("query_id", "chunk_id", "source", "rel_path", "sha256", "parent_path", "revision_label", "revision_family", "revision_state")


def listed_passages(s, d):
    hits = retrieval.bm25(_gold_queries(s, d), _chunks(s, d), 15)
    t = retrieval.listed_passages(retrieval.hydrated(hits, table(s, d, "chunks"), _docs(s, d)).withColumn("pos", F.col("rank")))
    return t.select("query_id", "n", F.md5("passages").alias("digest"))


def thinnest_documents(s, d):
    return audit.thinnest(_docs(s, d), table(s, d, "chunks"), F.col("doc_id") % 3 != 0, limit=50)


def copies_state(s, d):
    """With made-up states of the files."""
    return audit.copies_state(_docs(s, d), F.col("doc_id") % 5 != 0, F.col("doc_id") % 7 != 0).groupBy("state").agg(F.count("*").alias("documents"), F.min("rel_path").alias("least"))


def _named_queries(s, d):
    e = table(s, d, "equipment").where("canonical_name is not null")
    return e.select((-F.col("equipment_id")).alias("query_id"), F.concat(F.lit("Where is the manual of the "), "canonical_name", F.lit("?")).alias("text"))


def eligible_chunks(s, d):
    c = table(s, d, "chunks")
    gone = _docs(s, d).where("doc_id % 10 = 3").select("rel_path")
    return retrieval.eligible_chunks(c, _docs(s, d), ["10_power", "40_fire"], gone).join(c.select("chunk_id", "document_id").distinct(), "chunk_id").groupBy("document_id").agg(F.count("*").alias("chunks"))


def _candidates(s, d):
    v = _items(s, d)
    return retrieval.nearest(_stated(v), v.select("chunk_id", "vector"), 8).select("query_id", "chunk_id", F.col("rank").alias("pos"))


def rerank_permutation(s, d):
    c = _candidates(s, d)
    q = c.select("query_id").distinct()
    n = lambda k, m: (F.pmod(F.floor(F.col("query_id") / 20) + k, F.lit(m)) + 1).cast("string")
    reply = F.when(F.col("query_id") % 100 == 0, "no list").otherwise(F.concat(F.lit("Best first: ["), n(3, 8), F.lit(", "), n(5, 8), F.lit(", 99, "), n(3, 8), F.lit("] as asked")))
    return retrieval.permuted(c, q.select("query_id", reply.alias("reply")))


def rerank_scores(s, d):
    c = _candidates(s, d)
    seq = F.sequence(F.lit(1), F.when(F.col("query_id") % 60 == 0, 7).otherwise(8))
    q = c.select("query_id").distinct().select("query_id", F.transform(seq, lambda i: F.pmod(F.col("query_id") / 20 + i * 3, F.lit(5)).cast("double")).alias("scores"))
    return retrieval.rescored(c, q)


def _answers(s, d):
    answer = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.coalesce("summary", F.lit("It is so")), F.when(F.col("doc_id") % 3 == 0, " [1]").otherwise(""), F.lit(" and ["), (F.col("doc_id") % 7).cast("string"), F.lit("]")))
    return _docs(s, d).select("doc_id", answer.alias("answer"), (F.col("doc_id") % 5).cast("int").alias("sources"))


def citation_check(s, d):
    c = answers.citations(F.col("answer"), F.col("sources"))
    a = _answers(s, d).withColumn("c", c)
    return a.select(
        "doc_id", F.array_join(F.transform("c.numbers", lambda x: x.cast("string")), ",").alias("numbers"), F.size("c.valid").alias("valid"), F.size("c.invalid").alias("invalid"), "c.all_valid",
        answers.scrubbed(F.col("answer"), F.col("sources")).alias("scrubbed"), answers.state(F.lit(None).cast("string"), F.col("sources"), F.col("answer")).alias("state"),
    )


def _hit_lists(s, d):
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).where("text is not null").join(_docs(s, d).select(F.col("doc_id").alias("document_id"), "source", "domain"), "document_id")
    return c.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", F.coalesce("source", F.lit("")).alias("source"), "domain", "text"))).alias("hits"))


def degraded_excerpts(s, d):
    return _hit_lists(s, d).select("document_id", answers.excerpts(F.col("hits")).alias("answer"))


def prompt_context(s, d):
    p = _hit_lists(s, d).select("document_id", answers.context(F.col("hits")).alias("p"))
    return p.select("document_id", F.md5("p").alias("digest"), F.length("p").alias("n"))


def eval_recall_mrr(s, d):
    hits = retrieval.bm25(_gold_queries(s, d), _chunks(s, d), 8)
    h = retrieval.hydrated(hits, table(s, d, "chunks"), _docs(s, d)).select(F.col("query_id").alias("gold_id"), "rank", "source")
    return evaluation.retrieval_metrics(evaluation.ranks(h, table(s, d, "gold")))


def answer_metrics(s, d):
    g = table(s, d, "gold")
    n = F.pmod(F.length("q"), F.lit(4))
    told = F.array_join(F.coalesce("expected_facts", F.array().cast("array<string>")), "; ")
    answer = F.when(n == 0, F.concat(told, F.lit(" [1]"))).when(n == 1, F.concat(told, F.lit(" [3]"))).when(n == 2, F.lit("I could not find it, the service is offline.")).otherwise(told)
    sources = F.when(n == 2, 0).otherwise(2)
    return evaluation.answer_metrics(g.select("category", "expected_behaviour", "expect_citations", "expected_facts", answer.alias("answer"), sources.alias("sources"), F.array(F.coalesce("passage", F.lit(""))).alias("passages")))


def gold_contract(s, d):
    c = evaluation.contract(table(s, d, "gold"))
    return c.select("gold_id", F.size("reasons").alias("reasons"))


def secrets_gate(s, d):
    leak = F.when(F.col("doc_id") % 97 == 5, "\npassword = 'hunter2-long'").when(F.col("doc_id") % 97 == 6, "\n-----BEGIN RSA PRIVATE KEY-----\nMIIE").when(F.col("doc_id") % 97 == 7, "\napi_key: 0123456789abcdef0123").otherwise("")
    t = _texts(s, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), leak).alias("t"))
    return t.select("doc_id", F.array_join(audit.secret_reasons(F.col("t")), ",").alias("reasons")).where("reasons <> ''")


def degenerate_summaries(s, d):
    return _docs(s, d).where("summary is not null").select("doc_id", audit.degenerate(F.col("summary")).alias("degenerate"))


def extraction_warnings(s, d):
    notes = F.when(F.col("doc_id") % 50 == 1, "\n[OCR limited to first 20 pages]").when(F.col("doc_id") % 50 == 2, "\n[OCR error on page 3]").when(F.col("doc_id") % 50 == 3, "\n[rows truncated]").otherwise("")
    t = _docs(s, d).select("doc_id", F.concat(F.coalesce("text", F.lit("")), notes).alias("t"), F.lower(F.trim("extractor")).alias("e"), (F.col("doc_id") % 4).alias("p"))
    return t.select("doc_id", F.array_join(audit.extraction_warnings(F.col("t"), F.col("e"), F.col("p")), ",").alias("warnings"))


def unprocessed_docs(s, d):
    return audit.unprocessed(_docs(s, d), table(s, d, "chunks"), _links(s, d).select("document_id").dropna())


def entity_input(s, d):
    t = audit.entity_input(_docs(s, d), table(s, d, "chunks"))
    return t.select("doc_id", F.md5("input").alias("digest"), F.length("input").alias("n"))


def classification_sample(s, d):
    t = _texts(s, d).where("text is not null").select("doc_id", segmentation.classification_sample(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").alias("n"))


def taxonomy_match(s, d):
    reply = F.concat(F.lit("I think <b>40_fire</think> it is "), F.coalesce("domain", F.lit("unknown")), F.when(F.col("doc_id") % 4 == 0, " or 99_MISC").otherwise(""))
    t = _docs(s, d).select("doc_id", segmentation.answer_only(reply).alias("reply"))
    return t.select("doc_id", segmentation.taxonomy_match(F.col("reply"), TAXONOMY).alias("domain"))


def cooccurrence_pairs(s, d):
    return entities.shared(_links(s, d), 3).where("shared >= 3").select("a", "b", "shared")


def merge_candidates(s, d):
    return entities.proposals(_links(s, d), table(s, d, "equipment"), 3, 0.3)


def _payloads(s, d):
    """Entities as a model would give them: one payload per link, from the registry."""
    arr = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    e = table(s, d, "equipment").dropDuplicates(["equipment_id"])
    p = F.struct(F.array("canonical_name").alias("equipment"), F.array().cast("array<string>").alias("systems"), "make", "model", arr("tags_json").alias("tags"), arr("aliases_json").alias("synonyms"))
    return _links(s, d).dropna().distinct().join(F.broadcast(e), "equipment_id").select("document_id", p.alias("p"))


def registry_groups(s, d):
    r = entities.registry(entities.registry_keys(_payloads(s, d)))
    return r.select("equipment_key", "docs", F.array_join("aliases", "|").alias("aliases"), F.array_join("tags", "|").alias("tags"))


def registry_summary(s, d):
    return entities.registry_summary(entities.registry_keys(_payloads(s, d)))


def apply_merges(s, d):
    pairs = entities.proposals(_links(s, d), table(s, d, "equipment"), 3, 0.3)
    judged = pairs.select("a", "b", F.lit(1).alias("same"), F.when((F.col("a") + F.col("b")) % 3 == 0, 0.85).otherwise(0.95).alias("confidence"), F.lit("proposed").alias("status"))
    _, links, moves = entities.merged(table(s, d, "equipment"), _links(s, d), judged)
    n = links.groupBy("equipment_id").agg(F.count("*").alias("documents"))
    return moves.join(n.withColumnRenamed("equipment_id", "kept"), "kept").select("dropped", "kept", "documents")


def json_payload(s, d):
    o = F.concat(F.lit('{"make": "M'), (F.col("doc_id") % 5).cast("string"), F.lit('", "tags": ["T'), F.col("doc_id").cast("string"), F.lit('"], "extra": 1}'))
    n = F.col("doc_id") % 4
    reply = F.when(n == 0, o).when(n == 1, F.concat(F.lit("Sure:\n```json\n"), o, F.lit("\n```\n"))).when(n == 2, F.concat(F.lit("Here it is "), o, F.lit(" done"))).otherwise("nothing of the kind")
    p = _docs(s, d).select("doc_id", entities.payload(reply).alias("p"))
    return p.select("doc_id", "p.make", F.get("p.tags", F.lit(0)).alias("tag"))


def latest_state(s, d):
    p = table(s, d, "ingest_pending").select("pending_id", "state", "updated_at", "batch_id").dropDuplicates()
    return ledger.latest(p, "pending_id", ["updated_at", "state"]).select("pending_id", "state", "batch_id")


def dead_letters(s, d):
    p = table(s, d, "ingest_pending").select("pending_id", "state", "updated_at").dropDuplicates()
    return ledger.dead_letters(p, "pending_id", ["updated_at", "state"], "state").select("pending_id")


def _log(s, d):
    kinds = s.createDataFrame([(k, v) for k, v in oracle.ACTIONS.items()], "event_type string, action string")
    return table(s, d, "events").join(F.broadcast(kinds), "event_type", "left").select(F.col("user_id").alias("src"), F.coalesce("action", F.lit("error")).alias("action"), "ts", "event_id")


def attempt_fold(s, d):
    return ledger.attempts(_log(s, d), "src", ["ts", "event_id"])


def consistency_audit(s, d):
    return audit.consistency(_docs(s, d), table(s, d, "chunks"), table(s, d, "vchunks"), table(s, d, "ingest_pending"))


def _facts(s, d):
    """Of every pending record: whether a document has its digest, and made-up states of its files."""
    p = table(s, d, "ingest_pending").groupBy("pending_id").agg(F.max("sha256").alias("sha256"), F.max("rel_path").alias("rel_path"))
    known = _docs(s, d).where("sha256 is not null").select("sha256", F.lit(True).alias("document")).distinct()
    return p.join(known, "sha256", "left").select("pending_id", "rel_path", F.coalesce("document", F.lit(False)).alias("document"), (F.col("pending_id") % 3 != 0).alias("curated"), (F.col("pending_id") % 2 == 0).alias("source"))


def reconcile_actions(s, d):
    decision, retry = ledger.reconciled(F.col("document"), F.col("curated"), F.col("source"))
    return _facts(s, d).select("pending_id", decision.alias("decision"), retry.alias("retry"))


def ingest_actions(s, d):
    t = table(s, d, "staged_text").groupBy("pending_id").agg(F.max("text").alias("text"))
    f = _facts(s, d).join(t, "pending_id", "left")
    action = ledger.outcome(F.col("pending_id") % 101 != 0, F.col("rel_path"), F.col("rel_path").rlike(audit.SECRET_NAMES), F.col("document"), F.col("text"), F.size(audit.secret_reasons(F.col("text"))) > 0)
    return f.select("pending_id", action.alias("action"))


def snapshot_upsert(s, d):
    p = table(s, d, "ingest_pending").select("pending_id", "state", "updated_at").dropDuplicates()
    old = p.where("state in ('staged', 'curated')")
    w = ledger.latest(old, "pending_id", ["updated_at", "state"])
    new = ledger.latest(p.where("state in ('indexed', 'dead_letter')"), "pending_id", ["updated_at", "state"])
    return entities.upserted(w, new.select(*w.columns), "pending_id", "updated_at").select("pending_id", "state")


def promoted_names(s, d):
    p = table(s, d, "ingest_pending").where("sha256 is not null").groupBy("pending_id").agg(F.max("sha256").alias("sha256"), F.max("dest_rel_path").alias("dest_rel_path"))
    f = p.select(F.lpad(F.col("pending_id").cast("string"), 12, "0").alias("rel_path"), F.regexp_extract("dest_rel_path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("dest_rel_path", "([^/]*)$", 1).alias("base"), "sha256")
    return files.promoted_names(f).select("rel_path", "dest")


def register_rows(s, d):
    lines = _docs(s, d).where("text is not null").select("doc_id", F.posexplode(F.split("text", "\\n")).alias("row_no", "line"))
    return files.tsv(files.register(lines.select("doc_id", "row_no", F.split("line", "\\t").alias("cells")), "serial", "doc_id"), "doc_id")


def inbox_candidates(s, d):
    f = table(s, d, "ingest_pending").select(F.col("src_path").alias("rel_path")).distinct()
    done = table(s, d, "ingest_pending").where("state = 'indexed'").select(F.col("src_path").alias("src"))
    return files.candidates(f, done)


def gain_gate(s, d):
    t = audit.chars_of(table(s, d, "chunks"))
    new = F.col("chars") + F.pmod("document_id", F.lit(5)) * 100
    return t.select("document_id", audit.gain(F.col("chars"), new, F.col("document_id") % 13 == 0, F.col("document_id") % 7 == 0).alias("action"))


def dpi_cap(s, d):
    p = table(s, d, "part").select("p_partkey", (F.col("p_size") * 1.5).alias("w"), (F.col("p_size") * 0.9).alias("h"))
    return p.select("p_partkey", audit.dpi(F.col("w"), F.col("h"), 300).alias("dpi"))


def fold_unicode(s, d):
    t = _texts(s, d).where("text is not null").select("doc_id", T.ascii_punctuation(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5("t").alias("digest"))




QUERIES = {
    "domain_stats": lambda s, d: audit.domain_stats(_docs(s, d)),
    "corpus_totals": lambda s, d: audit.totals(_docs(s, d), table(s, d, "chunks"), table(s, d, "equipment")),
    "chunk_packed": lambda s, d: segmentation.chunked(_texts(s, d)),
    "exact_dup_groups": lambda s, d: dedupe.exact_groups(_texts(s, d)),
    "near_dup_clusters": lambda s, d: dedupe.clusters(_texts(s, d)),
    "thin_documents": lambda s, d: audit.thin(_docs(s, d), table(s, d, "chunks")),
    "stale_documents": lambda s, d: audit.stale(_docs(s, d), oracle.NOW, oracle.STALE_DAYS),
    "content_signature": lambda s, d: audit.content_signature(_docs(s, d).select("doc_id", "rel_path", "sha256", "text")),
    **{
        f.__name__: f
        for f in (
            domain_zero_fill, chunk_windows, source_reassembly, normalised_text, shingle_counts, minhash_signatures, lsh_pairs, revision_parse, revision_families, superseded_paths, bm25_topk,
            knn_l2_topk, knn_eligible, hybrid_search, rrf_fusion, entity_boost, eligible_chunks, rerank_permutation, rerank_scores, citation_check, degraded_excerpts, prompt_context, eval_recall_mrr,
            answer_metrics, gold_contract, secrets_gate, degenerate_summaries, extraction_warnings, unprocessed_docs, entity_input, classification_sample, taxonomy_match, cooccurrence_pairs,
            merge_candidates, registry_groups, registry_summary, apply_merges, json_payload, latest_state, dead_letters, attempt_fold, consistency_audit, reconcile_actions, ingest_actions,
            boosted_fusion, hit_metadata, listed_passages, thinnest_documents, copies_state, snapshot_upsert, promoted_names, register_rows, inbox_candidates, gain_gate, dpi_cap, fold_unicode,
        )
    },
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return {k: v for k, v in oracle.SQL.items() if k in QUERIES}
