import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import answers, audit, baskets, components, dedupe, entities, evaluation, ledger, retrieval, revisions, segmentation


def values(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_words_follow_nfkc_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, "Ａbc １²_x-ﬁn"), (2, None), (3, "")], "i int, t string")
    got = {r.i: r.w for r in df.select("i", T.words(F.col("t")).alias("w")).collect()}
    assert got == {1: ["abc", "12", "x", "fin"], 2: None, 3: []}


def test_chunks_pack_paragraphs_and_window_long_ones(spark):
    text = "short one\n\nshort two\n\n" + "x" * 3300 + "\n\nend"
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n\n ")], "doc_id long, text string")
    rows = segmentation.chunked(df).orderBy("doc_id", "seq").collect()
    assert [len(r.chunk) for r in rows] == [20, 1800, 1700, 100, 3]  # the last window lies within the one before
    assert rows[0].chunk == "short one\n\nshort two" and {r.doc_id for r in rows} == {1}


def test_bm25_counts_phrases_and_repeated_terms(spark):
    chunks = spark.createDataFrame([(1, "FP-101 pump"), (2, "the pump 101 fp"), (3, None), (4, "valve"), (5, "other words")], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "FP-101"), (2, "valve"), (3, "valve valve"), (4, "?!")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.bm25(q, chunks, 10).collect()}
    assert set(got) == {(1, 1), (2, 4), (3, 4)}
    assert abs(got[3, 4] - 2 * got[2, 4]) < 1e-5


def test_fusion_scores_and_order(spark):
    v = spark.createDataFrame([(1, 7, 0), (1, 8, 1)], "query_id long, chunk_id long, pos int")
    x = spark.createDataFrame([(1, 7, 0), (1, 9, 1)], "query_id long, chunk_id long, pos int")
    rows = retrieval.ordered(retrieval.fuse(v, x), 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [(7, 0.033333), (8, 0.016393), (9, 0.016393)]  # ties: the vector arm first


def test_eligible_rows_are_not_starved(spark):
    rows = [(i, [1.0, float(i) / 1000]) for i in range(501)] + [(900, [5.0, 5.0])]
    vectors = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    arm = retrieval.eligible_arm(q, vectors, spark.createDataFrame([(900,)], "chunk_id long"), 8)
    assert values(arm, "chunk_id", "pos") == [(900, 0)]


def test_golden_ranks(spark):
    hits = spark.createDataFrame([("a", 1, "Other.PDF"), ("a", 2, "the-Manual.pdf"), ("b", 1, "x")], "gold_id string, rank int, source string")
    gold = spark.createDataFrame([("a", "manual"), ("b", "zzz"), ("c", None)], "gold_id string, expect_source string")
    r = evaluation.retrieval_metrics(evaluation.ranks(hits, gold)).first()
    assert (r.questions, r.recall, r.mrr) == (2, 0.5, 0.25)


def test_permutations_are_repaired(spark):
    c = spark.createDataFrame([(q, i * 10, i) for q in (1, 2, 3, 4) for i in (1, 2, 3)], "query_id long, chunk_id long, pos long")
    r = spark.createDataFrame([(1, "Sure: [3, 1, 2]."), (2, "[3,3,99,1]"), (3, "no")], "query_id long, reply string")
    rows = retrieval.permuted(c, r).orderBy("query_id", "rank").collect()
    assert [x.chunk_id for x in rows] == [30, 10, 20, 30, 10, 20, 10, 20, 30, 10, 20, 30]
    s = spark.createDataFrame([(1, [0.1, 0.9, 0.9]), (2, [1.0])], "query_id long, scores array<double>")
    rows = retrieval.rescored(c.where("query_id < 3"), s).orderBy("query_id", "rank").collect()
    assert [x.chunk_id for x in rows] == [20, 30, 10, 10, 20, 30]


def test_citations_and_states(spark):
    rows = [("ok [1]", 2), ("[1] and [99]", 2), ("[99]", 2), ("", 2), ("x", 0), (None, 1), ("[99999999999999]", 1)]
    df = spark.createDataFrame(rows, "a string, n int")
    got = [r[0] for r in df.select(answers.state(F.lit(None).cast("string"), F.col("n"), F.col("a"))).collect()]
    assert got == ["grounded", "partial", "degraded", "degraded", "no_relevant", "degraded", "degraded"]
    assert df.select(answers.scrubbed(F.col("a"), F.col("n"))).collect()[1][0] == "[1] and [invalid citation removed]"


def test_components_of_chains_hubs_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3)]
    got = dict(values(components.connected_components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and 200 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_meet_and_copies_stand_for_one(spark):
    base = " ".join(f"word{i}" for i in range(200))
    docs = [(1, base), (2, base), (3, base.replace("word50", "other")), (4, " ".join(f"else{i}" for i in range(200))), (5, None), (6, "")]
    got = dict(values(dedupe.clusters(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "cluster"))
    assert got == {1: 1, 2: 1, 3: 1}


def test_revisions(spark):
    rows = [(1, "d/pump_manual_revA.pdf", 5), (2, "d/pump_manual_revB.pdf", 5), (3, "d/pump_manual_rev2.pdf", 5), (4, "e/pump_manual_revA.pdf", 5), (5, "d/longer name (2).md", 50), (6, "d/longer name (3).md", 2), (7, None, 1)]
    docs = spark.createDataFrame([(i, p, "x", n) for i, p, n in rows], "doc_id long, rel_path string, domain string, n_chunks int")
    texts = docs.select("doc_id", F.lit("short").alias("text"))
    got = dict(values(revisions.families(docs, texts), "doc_id", "verdict"))
    assert got == {1: "supersede", 2: "keep", 5: "held", 6: "keep"}


def test_registry_keys_guards_and_merges(spark):
    p = "document_id long, p struct<equipment:array<string>,make:string,model:string,tags:array<string>,synonyms:array<string>>"
    rows = [(1, (["Chiller"], "Aurora Power, Inc.", "APG-500", ["DG1", "not a tag at all"], None)), (2, (None, "aurora power", "apg-500", None, ["Big"])), (3, (None, "null", None, None, None))]
    r = entities.registry(entities.registry_keys(spark.createDataFrame(rows, p)))
    assert values(r, "equipment_key", "docs") == [("make-model:aurora power apg-500", 2), ("tag:dg1", 1)]
    links = spark.createDataFrame([(e, d) for e in (1, 2, 3, 4) for d in (1, 2, 3, 4)] + [(None, 1)], "equipment_id long, document_id long")
    eq = spark.createDataFrame([(1, "DG1", None, None, "[]", "[]"), (2, "DG2", "M", None, "[]", "[]"), (3, "MSB-1", None, "", '["x"]', "[]"), (4, "Panel", "M", "1", '["y"]', None)], "equipment_id long, canonical_name string, make string, model string, aliases_json string, tags_json string")
    assert values(entities.proposals(links, eq), "a", "b") == [(1, 4), (2, 3), (2, 4), (3, 4)]  # DG1/DG2 and DG1/MSB-1 are guarded
    judged = spark.createDataFrame([(3, 4, 1, 0.9, "proposed"), (1, 4, 1, 0.85, "proposed")], "a long, b long, same int, confidence double, status string")
    new, relinked, moves = entities.merged(eq, links, judged)
    assert values(moves, "dropped", "kept") == [(3, 4)] and new.where("equipment_id = 4").first().aliases_json == '["MSB-1","x","y"]'
    assert relinked.count() == 12


def test_attempts_fold_and_latest(spark):
    log = [("a", "error", 1), ("a", "error", 2), ("a", "retry_requested", 3), ("a", "error", 4), ("b", "processed", 1), ("c", "error", 1), ("c", "error", 2), ("c", "skip_unsafe", 3), (None, "error", 1)]
    df = spark.createDataFrame(log, "src string, action string, n int")
    assert values(ledger.attempts(df, "src", ["n"]), "src", "attempts", "done") == [("a", 1, False), ("b", 0, True), ("c", 3, True)]
    assert values(ledger.latest(df, "src", ["n"]), "src", "action") == [("a", "error"), ("b", "processed"), ("c", "skip_unsafe")]


def test_gates(spark):
    long = "x" * 200_000
    rows = [(1, long + " api_key = 0123456789abcdef0123"), (2, "password=hunter22"), (3, "clean prose"), (4, None), (5, "-----BEGIN PRIVATE KEY-----")]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", audit.secret_reasons(F.col("t")).alias("s")).collect()}
    assert got == {1: ["api_key"], 2: ["password"], 3: [], 4: [], 5: ["private_key"]}
    rows = [("short",), ("the " * 30,), ("a" * 40,), ("A fine summary of the pump.",)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").select(audit.degenerate(F.col("t"))).collect()] == [True, True, True, False]


def test_extra_and_clashing_columns_are_harmless(spark):
    docs = spark.createDataFrame([(1, "pump " * 100, 9, "x"), (2, "pump " * 100, 9, "y")], "doc_id long, text string, id int, rep string")
    assert dedupe.exact_groups(docs).first().members == 2
    assert dedupe.near_pairs(dedupe.signatures(docs)).count() == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, rel_path string, domain string, n_chunks int")
    chunks = spark.createDataFrame([], "chunk_id long, document_id long, seq int, text string")
    q = spark.createDataFrame([], "query_id long, text string, vector array<float>")
    assert dedupe.clusters(docs).count() == 0
    assert revisions.families(docs, docs).count() == 0
    assert retrieval.bm25(q, chunks, 5).count() == 0
    vectors = spark.createDataFrame([], "chunk_id long, vector array<float>")
    assert retrieval.distances(q, vectors, 5).count() == 0
    assert retrieval.eligible_arm(q, vectors, vectors.select("chunk_id"), 2).count() == 0
    assert segmentation.reassembled(chunks).count() == 0


def test_models_are_injected(spark):
    from corpusmill.models import text_model

    said = entities.extracted(spark.createDataFrame([(1, "one"), (2, "bad")], "doc_id long, input string"), text_model(lambda t: 'ok {"make": "M"}' if t == "one" else 1 / 0))
    assert [(r.document_id, r.p.make) for r in said.collect()] == [(1, "M")]
    pairs = spark.createDataFrame([(1, 2, 3, "x"), (3, 4, 3, "y")], "a long, b long, shared long, question string")
    got = entities.adjudicated(pairs, text_model(lambda t: '{"same": true, "confidence": 0.95}' if t == "x" else "?"))
    assert values(got, "a", "same", "confidence") == [(1, 1, 0.95), (3, 0, 0.0)]


def test_requeue_takes_the_last_record(spark):
    q = spark.createDataFrame([("a", "requested", 1), ("b", "requested", 1), ("b", "cancelled", 2), ("c", "requested", 1)], "src string, action string, ts int")
    log = spark.createDataFrame([("c", "processed", 5)], "src string, action string, ts int")
    assert values(ledger.requeued(q, ["ts"], log), "src") == [("a",)]


def test_vector_arm_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 50)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 6)) * 2) / 2  # many ties
    x[100:140] = x[0]
    bad = [(9000, None), (9001, [1.0] * 5), (9002, [float("nan")] * 6)]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + bad, "chunk_id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 700, 20)] + [(9000, None)], "query_id long, vector array<double>")
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6)
    order = {i: sorted(range(700), key=lambda j: (d[i, j], j)) for i in range(0, 700, 20)}
    got = {(r.query_id, r.rank): r.chunk_id for r in retrieval.nearest(q, v, 9).collect()}
    assert got == {(i, n + 1): order[i][n] for i in order for n in range(9)}
    for share in (2, 97, 400):  # the rarer, the further the fetch reaches
        ok = set(range(0, 700, share))
        want = set()
        for i, o in order.items():
            places = [n + 1 for n, j in enumerate(o) if j in ok]
            reach = 20
            while len(places) >= 20 and reach < places[19]:
                reach *= 2
            reach = 700 if len(places) < 20 else min(700, reach)
            want |= {(i, o[n - 1], e) for e, n in enumerate(places) if n <= reach}
        arm = retrieval.eligible_arm(q, v.where("chunk_id < 9000"), spark.createDataFrame([(j,) for j in ok], "chunk_id long"), 2)
        assert {(r.query_id, r.chunk_id, r.pos) for r in arm.collect()} == want


def test_buckets_and_baskets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedupe, "BUCKET", 3)
    monkeypatch.setattr(baskets, "BLOCK", 4)
    keys = spark.createDataFrame([(i, 7) for i in range(20)] + [(i, 8) for i in range(18, 24)], "rep long, key long")
    met = {tuple(r) for r in dedupe.met_in_blocks(keys).collect()}
    assert met == {(i, j) for i in range(20) for j in range(i + 1, 20)} | {(i, j) for i in range(18, 24) for j in range(i + 1, 24)}
    links = spark.createDataFrame([(e, d) for d, n in ((1, 13), (2, 13), (3, 9), (4, 2), (5, 1)) for e in range(n)] + [(None, 1), (0, 4)], "equipment_id long, document_id long")
    n = lambda e: sum(e < x for x in (13, 13, 9, 2, 1))
    assert {tuple(r) for r in entities.shared(links, 2).collect()} == {(a, b, n(b), n(a), n(b)) for a in range(13) for b in range(a + 1, 13) if n(b) >= 2}
