import itertools
import random
import re
import shutil
import tracemalloc
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import cells, copies, encode, graph, history, leaks, near, pieces, residue, scans, together, vectors

W = re.compile(r"[^\W_]+")


def words(t):
    return W.findall(unicodedata.normalize("NFKC", t).lower())


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y) if min(len(words(a)), len(words(b))) >= 30 else 0


def texts(n, seed=1, size=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = [" ".join(rng.choices(vocabulary, k=size)) for _ in range(n)]
    for _ in range(n):  # near copies at all distances
        w = rng.choice(out[:n]).split()
        for _ in range(rng.randrange(0, 7)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [rng.choice(vocabulary)]
        out.append(" ".join(w))
    return out


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


CHUNKS = "chunk_id long, document_id long, seq int, text string"


def test_p2_copies_against_brute_force(spark):
    t = [
        (1, "A Pump, is ON."), (2, "a pump is on"), (3, "a  PUMP\nis—on"), (4, None), (5, ""), (6, "..."), (7, "Tag: X1\nRoom: 5 b\nMake: Q"), (8, "make=q | room=5 B | tag=x1"),
        (9, "Tag: X1\nRoom: 5 c\nMake: Q"), (10, "tag x1 room 5 b make q"), (11, "other"), (2, "a pump is on"), (12, "K: a\nL: b"), (13, "L: b\nK: a"), (14, "Ｍake＝q"),
    ]
    df = spark.createDataFrame([(i, 1, 0, x) for i, x in t], CHUNKS).withColumn("id", F.lit(3)).withColumn("key", F.lit("x"))
    assert rows(copies.copies(df), "chunk_id_a", "chunk_id_b") == [(1, 2), (1, 3), (7, 8), (7, 10)]
    assert (7, 3) in rows(copies.counts(df), "chunk_id", "copies")
    assert copies.copies(df.limit(0)).count() == 0


def test_p2_hot_key_spreads_over_partitions(spark):
    df = spark.range(30_000).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 3 == 0, "the Same text").otherwise(F.col("id").cast("string")).alias("text"))
    got = copies.copies(df)
    assert got.count() == 9999 and got.select("chunk_id_a").distinct().collect()[0][0] == 0


def test_p2_runs_over_batches_and_borders(spark, monkeypatch):
    monkeypatch.setattr(copies, "LONG", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        t = ["same words here" if i % 3 == 0 else f"pair {i // 10}" if i % 3 == 1 else f"alone {i}" for i in range(900)]
        got = rows(copies.copies(spark.createDataFrame([(i, 1, 0, x) for i, x in enumerate(t)], CHUNKS).repartition(7)), "chunk_id_a", "chunk_id_b")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = {}
    for i, x in enumerate(t):
        first.setdefault(x, i)
    assert got == sorted((first[x], i) for i, x in enumerate(t) if first[x] != i)


def test_p7_all_pairs_under_the_distance_meet(spark):
    t = texts(150, 5)
    df = spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", near.T.word_hashes(F.col("t")).alias("w"))
    w = df.orderBy("id").toArrow()
    sig = near.signature(*near.runs(*near.flat(w.column(1)), near.SHINGLE))
    distance = (sig[:, None] != sig[None]).sum(2)
    most = near.CHUNKS * (near.ERRORS + 1) - 1
    want = {(i, j) for i, j in itertools.combinations(range(300), 2) if distance[i, j] <= most}
    got = {tuple(r) for r in near.candidates(df, 0.7).collect()}
    assert want <= got and len(want) > 50 and sig.max() < 2**near.BITS


def test_p7_bound_leaves_out_no_similar_pair():
    rng = np.random.default_rng(8)
    sets = [set(rng.integers(0, 2000, rng.integers(30, 300)).tolist()) for _ in range(40)]
    sets += [set(list(s)[: int(len(s) * 0.9)]) | {5000 + i} for i, s in enumerate(sets)]
    bits = np.zeros((80, near.MAP), np.float32)
    for i, s in enumerate(sets):
        bits[i, [x % near.MAP for x in s]] = 1
    n = np.array([len(s) for s in sets])
    may = near.may_be_similar(bits, bits, n, n, 0.7)
    real = np.array([[len(a & b) >= 0.7 * len(a | b) for b in sets] for a in sets])
    assert (may | ~real).all() and may.sum() < 3 * real.sum()


def test_p7_hot_key_of_a_third_of_all_rows_runs_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        base = texts(1, 6)[0].split()
        t = [" ".join([*base[:-1], f"end{i}"]) for i in range(100)] + texts(100, 7)
        got = rows(near.found(spark.createDataFrame([(i, i, 0, x) for i, x in enumerate(t)], CHUNKS)), "chunk_id_a", "chunk_id_b")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(i, j) for i, j in itertools.combinations(range(len(t)), 2) if jaccard(t[i], t[j]) >= 0.7 and words(t[i]) != words(t[j])]
    assert got == want and len(want) > 4950


def test_p7_all_pairs_against_brute_force(spark):
    t = [*texts(120), None, "", "short text"]
    df = spark.createDataFrame([(i, i, 0, x) for i, x in enumerate(t)] + [(0, 0, 0, t[0])], CHUNKS)
    want = [(i, j) for i, j in itertools.combinations(range(240), 2) if jaccard(t[i], t[j]) >= 0.7 and words(t[i]) != words(t[j])]
    assert rows(near.found(df), "chunk_id_a", "chunk_id_b") == want and len(want) > 30
    assert near.found(df.limit(0)).count() == 0


def test_p7_records_parted_by_any_line_break_are_copies(spark):
    t = []
    for n, sep in enumerate("\n\x0b\x0c\x85\u2028\u2029"):
        fields = [f"Field {k}: " + " ".join(f"w{n}x{k}y{j}" for j in range(40)) for k in range(3)]
        t += [sep.join(fields), sep.join(fields[1:] + fields[:1])]
    df = spark.createDataFrame([(i, 1, 0, x) for i, x in enumerate(t)], CHUNKS)
    assert rows(copies.copies(df), "chunk_id_a", "chunk_id_b") == [(i, i + 1) for i in range(0, len(t), 2)]
    assert rows(near.found(df), "chunk_id_a", "chunk_id_b") == []


def test_p7_long_runs_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 8)
    base = texts(1, 5)[0].split()
    t = [" ".join([*base[:-1], f"end{i}"]) for i in range(60)]
    got = near.found(spark.createDataFrame([(i, i, 0, x) for i, x in enumerate(t)], CHUNKS))
    assert got.count() == 60 * 59 // 2


def test_p7_signature_guarantee():
    rng = np.random.default_rng(3)
    size, most = near.SLOTS // near.CHUNKS, near.CHUNKS * (near.ERRORS + 1) - 1
    for _ in range(300):  # any choice of so many differing slots leaves a chunk with at most ERRORS of them
        differ = np.zeros(near.SLOTS, int)
        differ[rng.choice(near.SLOTS, most, replace=False)] = 1
        assert differ.reshape(near.CHUNKS, size).sum(1).min() <= near.ERRORS


def test_p1_batches_against_brute_force(spark):
    t = texts(60, 2)
    docs = spark.createDataFrame([(i, "%064x" % i, t[i]) for i in range(40)] + [(500, None, None)], "doc_id long, sha256 string, text string")
    pend = [(i, i % 5, "%064x" % (1000 + i)) for i in range(40, 120)] + [(200, 1, "SHA256:" + "%064X" % 7), (201, 2, " %064x\n" % 1040), (202, 3, None), (203, 4, "zz"), (40, 0, "%064x" % 1040)]
    p = spark.createDataFrame([(i, b, s, "staged") for i, b, s in pend], "pending_id long, batch_id int, sha256 string, state string")
    staged = spark.createDataFrame([(i, t[i]) for i in range(40, 120)] + [(202, None), (40, t[40])], "pending_id long, text string")
    order = sorted({(b, i) for i, b, _ in pend if 40 <= i < 120})
    want = {200: "exact", 201: "exact"}
    for k, (b, i) in enumerate(order):
        if any(jaccard(t[i], t[j]) >= 0.8 for j in [*range(40), *(x for _, x in order[:k])]):
            want[i] = "near"
    got = dict(rows(history.found(docs, p, staged), "pending_id", "kind"))
    assert set(got.items()) <= set(want.items()) and len(got) >= 0.97 * len(want) > 10
    assert history.found(docs, p.limit(0), staged).count() == 0


def test_p1_compaction_schedule():
    assert history.segments_before(0) == [] and history.segments_before(23) == [(0, 16), (16, 4), (20, 1), (21, 1), (22, 1)]
    for b in range(40):
        assert sorted(x for s, n in history.segments_before(b) for x in range(s, s + n)) == list(range(b))


def test_p1_many_cells_and_compaction_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 16)
    made, of = [], history.Cells.of
    monkeypatch.setattr(history.Cells, "of", lambda *a: made.append(of(*a)) or made[-1])
    t = texts(300, 8)
    docs = spark.createDataFrame([(i, None, t[i]) for i in range(400)], "doc_id long, sha256 string, text string")
    p = spark.createDataFrame([(i, i % 6, None) for i in range(400, 600)], "pending_id long, batch_id int, sha256 string")
    staged = spark.createDataFrame([(i, t[i]) for i in range(400, 600)], "pending_id long, text string")
    order = sorted(range(400, 600), key=lambda i: (i % 6, i))
    want = {i for k, i in enumerate(order) if any(jaccard(t[i], t[j]) >= 0.8 for j in [*range(400), *order[:k]])}
    got = {r[0] for r in rows(history.found(docs, p, staged), "pending_id")}
    assert len(made[0].centroids) >= 8 and got <= want and len(got) >= 0.98 * len(want) > 50


def test_p1_index_is_opened_again_and_reads_no_former_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 8)
    t = texts(60, 3)
    df = spark.createDataFrame([(i, i // 20, "%064x" % (i % 90), x) for i, x in enumerate(t)], "id long, batch long, sha string, text string")
    path, out = str(tmp_path / "index"), str(tmp_path / "out")
    first = history.recorded(df.where("batch = 0"))
    history.HistoryIndex.create(spark, path, history.cells_for(first.where("v is not null"), 20)).take(first)
    for b in range(1, 6):
        source = str(tmp_path / f"batch{b}")
        df.where(F.col("batch") == b).write.parquet(source)
        index = history.HistoryIndex(spark, path)
        index.take(history.recorded(spark.read.parquet(source)), out)
        shutil.rmtree(source)  # whatever reads a former batch again fails
    assert set(index.segments) == {(-1, 1), (0, 4), (4, 1)} and len(index.cells.centroids) >= 2
    told = spark.read.option("recursiveFileLookup", "true").schema("id long, exact boolean, same boolean").parquet(out + "/told")
    assert {r[0] for r in rows(told, "id") if r} >= set(range(90, 120))  # digests come again after 90
    met = {(r.id, r.met) for r in spark.read.option("recursiveFileLookup", "true").schema("id long, met long, cosine double").parquet(out + "/met").collect()}
    words_of = {i: words(x) for i, x in enumerate(t)}
    firsts = {i for i in range(120) if not any(words_of[j] == words_of[i] for j in range(i))}
    same = {(j, i) for i, j in itertools.combinations(sorted(firsts), 2) if j >= 20 and jaccard(t[i], t[j]) >= 0.8}
    assert all(j > i for j, i in met) and len(same & met) >= 0.98 * len(same) > 5
    left = history.HistoryIndex(spark, path)
    left.take(history.recorded(df.limit(0)), out)
    assert left.next == 6


def test_p6_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 64))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64)) * 0.8
    x[2500:] = x[:500] + rng.normal(size=(500, 64)) * 0.1
    bad = [(9001, None), (9002, [1.0] * 63), (9003, [0.0] * 64), (9004, [float("nan")] * 64), (9005, [None] * 64), (0, x[0].tolist())]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "chunk_id long, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    want = {(int(a), int(b)) for a, b in np.argwhere(s >= 0.9) if a < b}
    got = set(rows(vectors.similar(df), "chunk_id_a", "chunk_id_b"))
    assert len(got - {(a, b) for a, b in np.argwhere(s >= 0.899)}) == 0 and len(got & want) >= 0.99 * len(want) > 400
    top = np.argsort(-s, axis=1)[:, :10]
    ten = vectors.ten(df).select("chunk_id", "neighbour_id").collect()
    hit = sum(r.neighbour_id in top[r.chunk_id] for r in ten)
    assert hit >= 0.9 * 30_000 and len(ten) == 30_000
    assert vectors.ten(df.limit(1)).count() == 0


def test_p6_recall_at_many_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 8)
    made, of = [], vectors.Cells.of
    monkeypatch.setattr(vectors.Cells, "of", lambda *a: made.append(of(*a)) or made[-1])
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 4000)] + 0.8 * rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    near = x @ x.T
    np.fill_diagonal(near, -9)
    true = np.argsort(-near, axis=1)[:, :10]
    got = rows(vectors.ten(df), "chunk_id", "neighbour_id")
    assert len(set(got) & {(i, int(j)) for i in range(4000) for j in true[i]}) > 0.95 * 40_000
    assert len(made[0].centroids) == 106 and made[0].most == 21


def test_p6_found_is_ten_at_the_least_cosine_and_copies_are_no_crowd(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(900, 64))
    x[300:600] = x[7]  # a third of all are copies of one
    x[600:640] = x[:40] + 0.05 * rng.normal(size=(40, 64))
    x[700:702] = x[650]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "chunk_id long, embedding array<double>")
    ten = vectors.ten(df).collect()
    by = {}
    for r in ten:
        by.setdefault(r.chunk_id, []).append((r.rank, r.neighbour_id, r.cosine))
    assert len(by) == 900 and all(len(v) == 10 for v in by.values())
    assert [n for _, n, _ in sorted(by[7])] == list(range(300, 310)) and [n for _, n, _ in sorted(by[305])] == [7, *range(300, 305), *range(306, 310)]
    assert {n for _, n, c in by[607] if c >= 0.9} == {7, *range(300, 309)} and {n for _, n, c in by[650] if c > 0.99} == {700, 701}
    pairs = {(min(r.chunk_id, r.neighbour_id), max(r.chunk_id, r.neighbour_id)) for r in ten if r.cosine >= 0.9}
    assert set(rows(vectors.similar(df), "chunk_id_a", "chunk_id_b")) == pairs


def test_cells_of_two_levels_stay_small_and_find_the_near_ones():
    rng = np.random.default_rng(2)
    sample = rng.normal(size=(60_000, 64)).astype(np.float32) + 2 * rng.normal(size=(2000, 64)).astype(np.float32)[rng.integers(0, 2000, 60_000)]
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    tracemalloc.start()
    c = cells.Cells.of(sample, 10**8, 10_000, 16, 0.15)
    near, ok = c.near(sample[:10_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 9000 < len(c.centroids) < 11_000 and len(c.begin) > 90 and peak < 300e6
    best = (sample[:500] @ c.centroids.T).argmax(1)
    assert (near[:500, 0] == best).mean() > 0.97 and ok[:, 0].all() and np.isclose(c.share.sum(), 1)


def test_p6_prune_keeps_diverse_edges():
    x = np.array([[1, 0, 0], [0.8, 0.6, 0], [0.79, 0.61, 0], [0.78, -0.62, 0]], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    kept = graph.robust_prune(x, np.array([[1, 2, 3]], np.int32), (x[[1, 2, 3]] @ x[0])[None], 3, 1.0)[0]
    assert list(kept) == [1, 3, -1]  # 2 is nearer to 1 than to the point


def test_p4_pairs_against_brute_force(spark):
    rng = random.Random(1)
    base = [(e, d) for d in range(300) for e in rng.sample(range(12), rng.randrange(0, 6))] + [(7, d) for d in range(100)] + [(e, 999) for e in range(400)]
    base += [(1, None), (None, 2), *base[:50]]
    df = spark.createDataFrame(base, "equipment_id long, document_id long")
    link = {(e, d) for e, d in base if e is not None and d is not None}
    by = {}
    for e, d in link:
        by.setdefault(e, set()).add(d)
    n = len({d for _, d in link})
    want = [(a, b, len(by[a] & by[b])) for a, b in itertools.combinations(sorted(by), 2) if by[a] & by[b]]
    assert rows(together.scored(df), "equipment_id_a", "equipment_id_b", "n_ab") == want
    good = [(a, b) for a, b, k in want if k >= 5 and k * 1000 >= 2 * n and k * n >= 4 * len(by[a]) * len(by[b])]
    assert rows(together.notable(df), "equipment_id_a", "equipment_id_b") == good
    assert together.notable(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["word " * 900, "x" * 5000, ("A sentence here. " * 40 + "\n\n") * 8, "語" * 4001, "# H\n" + "line of text\n" * 300])
def test_p5_pieces_cover_the_text(text):
    s = pieces.spans(text)
    assert s[0][0] == 0 and s[-1][1] == len(text) and all(e - b <= 1800 for b, e in s)
    assert all(b2 == e1 - 200 and e2 > e1 for (_, e1), (b2, e2) in zip(s, s[1:]))
    if "\n\n" in text:
        assert all(text[e - 2 : e] in ("\n\n", ". ") or e == len(text) for _, e in s)


def test_p5_a_part_that_fits_is_not_cut():
    one, two = "a" * 1700, "b" * 1500
    assert pieces.spans(f"{one}\n\n{two}") == [(0, 1702), (1502, 3202)]
    assert pieces.spans("s. " * 100 + "\n\n" + "c" * 1790)[0] == (0, 302)


def test_p5_rows(spark):
    df = spark.createDataFrame([(1, 1, 0, "a" * 1800), (2, 1, 1, "b" * 1801), (3, 1, 2, None), (2, 1, 1, "b" * 1801), (4, 1, 3, "")], CHUNKS)
    assert rows(pieces.oversized(df), "chunk_id") == [(2,)] and pieces.pieces(df).count() == 2


def test_p8_ids_equal_a_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = ["Hello  world's 12,345 µm²!", None, "", " ", "a<|endoftext|>b", "多言語 テキスト\n\n  x", "naïve 　ﬁ\x1c\x85", "y" * 3000, "🙂👩‍🚀"]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode.ids(df).collect()}
    own = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    assert got == {i: own.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(t)}
    assert {r.doc_id: r.text for r in encode.decode(encode.ids(df)).collect()} == {i: x or "" for i, x in enumerate(t)}


def test_p9_runs_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(30)]
    gold = [(f"g{i}", " ".join(rng.choices(vocabulary, k=20)), None if i == 3 else " ".join(rng.choices(vocabulary, k=50))) for i in range(8)]
    docs = []
    for i in range(80):
        w = rng.choices(vocabulary, k=40)
        _, q, p = rng.choice(gold)
        src = (p or q).split()
        n = rng.randrange(9, 16)
        at = rng.randrange(len(src) - n)
        docs.append((i, " ".join(w[:20]) + " — " + ", ".join(src[at : at + n]).upper() + ". " + " ".join(w[20:])))
    docs += [(900, None), (901, ""), (902, "v1 v2")]
    want = set()
    for i, t in docs:
        w = words(t or "")
        have = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for g, q, p in gold:
            for x in (q, p):
                v = words(x or "")
                if have & {tuple(v[k : k + 12]) for k in range(len(v) - 11)}:
                    want.add((i, g))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    g = spark.createDataFrame(gold, "gold_id string, q string, passage string")
    assert set(rows(leaks.leaked(d, g), "doc_id", "gold_id")) == want and 10 < len(want) < 80
    assert leaks.leaked(d, g.limit(0)).count() == 0 and leaks.leaked(d.limit(0), g).count() == 0


def test_p10_residue_and_mentions(spark):
    yes = [
        "Please {{name}} sign", "Rate: ${rate.value}", "Unit [INSERT tag] runs", "Lorem ipsum dolor sit amet consectetur", "404 Not Found\nNothing is stored under /x/1", "Access denied. Your account may not open it.",
        "Your session has ended. Sign in again to view /a", "<noscript>You need to enable scripts</noscript>", "Traceback (most recent call last):\n  File", "blah text text more filler text blah text", "Seite nicht gefunden. Der Pfad /x ist nicht mehr vorhanden.",
    ]
    no = [
        'The field "{{make}}" is filled by the printer', "Explains why filler text such as lorem ipsum must not reach it", "When the panel shows error 404 the relay is cleaned", "The session timeout is 30 seconds", "A page not found message means the card is missing",
        "Scripts must be enabled on terminal X-1 before the trend is drawn", "Access denied is logged by the gate", "", "  \n", None,
    ]
    df = spark.createDataFrame([(i, "h", t) for i, t in enumerate(yes)] + [(100 + i, None, t) for i, t in enumerate(no)], "doc_id long, domain string, text string")
    assert [r[0] for r in rows(residue.found(df), "doc_id")] == list(range(len(yes)))
    assert residue.kept(df).count() == len(no) and residue.found(df.limit(0)).count() == 0


def test_p10_ordinary_messages_and_mentions(spark):
    yes = [
        "HTTP Error 503. The service is unavailable.", "Whoops, looks like something went wrong.", "You don't have JavaScript turned on.", "Dear [CUSTOMER NAME], your order [ORDER_ID]",
        "Sed ut perspiciatis unde omnis iste natus error sit voluptatem", "TBD - to be written", "XXXX XXXX XXXX", "This page isn't working. example.org didn't send any data. ERR_EMPTY_RESPONSE",
        "Checking your browser before accessing example.org", "502 - Bad Gateway", "HTTP/1.1 404 Not Found", "Please enable JavaScript and cookies to continue", "Dear «FirstName», welcome", "Error 404", "404",
        "An unexpected error has occurred. Please try again later.", "Click or tap here to enter text.", "Just a moment... we are checking your connection", "Error! Reference source not found.",
    ]
    no = [
        "The gateway logs HTTP error 503 when the link drops", "Scripts on the panel are signed before use", "The tag [TX-101] is fixed to the door", "[CAUTION] hot surface", "[Page 404]", "The sign says «насос»",
        "The installer reports 500 internal parts and 404 bolts", "Dolor in the knee is not a fault of the pump", "If something went wrong the relay opens", "The operator checks the connection of your pump", "Room 404", "ERR_12 means low flow",
        "Every page of the log is numbered; none is missing", "The list (to be added later by the planner) is in annex B",
    ]
    find = residue.finder()
    assert [t for t in yes if not find.kinds(t)] == [] and [(t, find.kinds(t)) for t in no if find.kinds(t)] == []
    assert [bool(find.kinds(t + "\n" + "plain words of a record " * 20)) for t in yes if not t.endswith("404")] == [True] * (len(yes) - 2)


@pytest.mark.parametrize("many", [19, 25, 200])
def test_p10_a_banner_is_no_case_but_a_bare_page_is(spark, many):
    menu = "Sign in to view your account"
    docs = [(i, "h", f"{menu}\n" + f"real content {i} " * 60) for i in range(many)] + [(999, "h", menu), (998, "h", f"{menu.upper()}\nRequest 17")]
    docs += [(1000 + i, "few", f"{menu}\n" + f"real content {i} " * 60) for i in range(2)]  # of so few texts nothing can be told
    df = spark.createDataFrame(docs, "doc_id long, domain string, text string")
    assert [r[0] for r in rows(residue.found(df), "doc_id")] == [998, 999, 1000, 1001]


def test_p10_recurrent_residue_is_found(spark):
    body = lambda i: f"real content {i} " * 60
    form, notice = "Prepared for [INSERT name]\n" + body("form"), body("notice") + "\nPage not found.\nThe path /a/b is gone."
    docs = [(i, "h", form) for i in range(30)] + [(i, "h", notice.upper() if i % 2 else notice) for i in range(30, 60)]  # copies, each a third of the host
    docs += [(i, "h", body(i)) for i in range(60, 90)]
    docs += [(i, "few", body(i) + ("\nCould not load the drawing" if i < 130 else "")) for i in range(100, 400)]  # 30 of 300 texts, no copies
    docs += [(i, "all", f"Owner: {{{{owner}}}}\nSign in to view your account\n{body(i)}") for i in range(400, 440)]  # placeholder on every page
    df = spark.createDataFrame(docs, "doc_id long, domain string, text string")
    got = rows(residue.evidence(df), "doc_id", "kind")
    assert got == [(i, "placeholder") for i in range(30)] + [(i, "error") for i in [*range(30, 60), *range(100, 130)]] + [(i, "placeholder") for i in range(400, 440)]


def a_match(tree, rng):
    """A random string for a parsed pattern; assertions are left to the caller."""
    out = ""
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(arg)
        elif op in ("NOT_LITERAL", "ANY"):
            out += rng.choice(" z")
        elif op == "IN":
            kind, x = rng.choice(arg) if str(arg[0][0]) != "NEGATE" else ("NEGATE", None)
            out += {"LITERAL": lambda: chr(x), "RANGE": lambda: chr(rng.randint(*x)), "NEGATE": lambda: rng.choice(" z"), "CATEGORY": lambda: {"WORD": "w", "DIGIT": "4", "NOT_SPACE": "x", "SPACE": " "}[str(x)[9:]]}[str(kind)]()
        elif op == "BRANCH":
            out += a_match(rng.choice(arg[1]), rng)
        elif op == "SUBPATTERN":
            out += a_match(arg[3], rng)
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(a_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        else:
            assert op in ("AT", "ASSERT", "ASSERT_NOT")
    return out


def test_p10_every_match_passes_its_gate(spark):
    rng = random.Random(5)
    for signs in [residue.PLACEHOLDERS, *residue.EVIDENCE.values()]:
        for hints, pattern in signs:
            made = [t for t in (a_match(re._parser.parse(pattern), rng) for _ in range(4000)) if re.search(pattern, t)]
            assert made, pattern
            assert [t for t in made if not any(h.lower() in t.lower() for h in hints)] == [], pattern
    yes = ["Test, test, test.", "test. test. test.", "text, text, text, text, text, text", "Sample, sample, more, sample, sample, more", "Bitte aktivieren Sie Scripte"]
    df = spark.createDataFrame([(i, None, t) for i, t in enumerate(yes)], "doc_id long, domain string, text string")
    assert [r[0] for r in rows(residue.found(df), "doc_id")] == list(range(len(yes)))


def test_p3_noise_and_mending(spark):
    clean = ["the shielded pump of the cross-bonded condenser is cleaned every 500 hours before the relay chatters in the control annexe"] * 4 + ["# TX-1 Data Sheet\nthe pump"] * 6
    scan = "[Page 1] # TX-1 Data Sheet\nThe shiel-\nded pump of the cross-\nbonded conden¬\n      TX-9 Data Sheet · Rev B\n   - 2 -\nser is c1eaned every 5O0\nhours before the rclay chatters in the confrol annexe"
    docs = spark.createDataFrame([(i, "text") for i in range(10)] + [(50, " OCR "), (51, None), (52, "ocr")], "doc_id long, extractor string")
    chunks = spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(clean)] + [(50, 50, 0, scan), (50, 50, 0, scan), (51, 51, 0, None), (52, 52, 0, "")], CHUNKS)
    got = rows(scans.found(chunks, docs), "chunk_id", "kind", "item")
    assert got == sorted(
        (50, k, i)
        for k, i in [("split", "shielded"), ("split", "cross-bonded"), ("split", "condenser"), ("header", "TX-9 Data Sheet · Rev B"), ("page", "- 2 -"), ("misread", "cleaned"), ("misread", "500"), ("misread", "relay"), ("misread", "control")]
    )
    text = {r.chunk_id: r.text for r in scans.repaired(chunks, docs).collect()}[50]
    assert "The shielded pump of the cross-bonded condenser is cleaned every 500 hours before the relay chatters in the control annexe" in text and "Rev B" not in text


def test_p3_repaired_text_against_the_text_before_the_scan(spark):
    """Held-out accuracy: clean pages are spoiled by misreadings, cuts at line ends and page furniture, and mended again."""
    rng = random.Random(12)
    syllables = ["ba", "co", "de", "fu", "gi", "lo", "ma", "ne", "po", "ru", "sa", "te", "vi", "wo", "zu"]
    vocabulary = sorted({"".join(rng.choices(syllables, k=rng.randrange(3, 5))) for _ in range(400)})
    sentence = lambda: " ".join(rng.choices(vocabulary, k=12))
    clean = [f"# TX-{i} Data Sheet\n" + " ".join(sentence() for _ in range(20)) for i in range(150)]
    pages, truth = [], []
    for i in range(40):
        w = " ".join(sentence() for _ in range(6)).split()
        lines, line = [], ""
        for x in w:
            y = x
            if rng.random() < 0.08:
                a, b = rng.choice([m for m in scans.MISREAD if m[1] in x])
                y = x.replace(b, a, 1) if not (a == "(" and x.startswith(b)) else x  # at the start of a word it is a bracket
            if len(line) + len(y) > 55:
                if rng.random() < 0.5 and len(y) > 5 and x == y:
                    lines.append(f"{line} {y[:3]}-".strip())
                    line = y[3:]
                    continue
                lines.append(line)
                line = ""
            line = f"{line} {y}".strip()
        lines = [*lines[:3], f"    TX-{i} Data Sheet · Rev B", f"- {i} -", *lines[3:], line]
        pages.append("\n".join(lines))
        truth.append(w)
    docs = spark.createDataFrame([(i, "text") for i in range(150)] + [(500 + i, "ocr") for i in range(40)], "doc_id long, extractor string")
    chunks = spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(clean)] + [(500 + i, 500 + i, 0, t) for i, t in enumerate(pages)], CHUNKS)
    got = {r.chunk_id - 500: r.text.split() for r in scans.repaired(chunks, docs).collect()}
    assert all(len(got[i]) == len(truth[i]) for i in range(40)), "furniture is gone, cut words are whole"
    right = sum(a == b for i in range(40) for a, b in zip(got[i], truth[i]))
    assert right >= 0.98 * sum(map(len, truth))


def test_p3_header_of_a_rare_title(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(40)] + [(50, "ocr"), (51, "ocr")], "doc_id long, extractor string")
    common = [(i, i, 0, "# TX-1 Data Sheet\nthe shielded pump is cleaned") for i in range(40)]
    own = (60, 50, 0, "one line\nanother\na third\n\n# TX-2 Ledger of Valves\nthe pump")  # in line five, in one document
    pages = [(61, 50, 1, "the shiel-\nTX-2 Ledger of Valves · Rev B\nded pump is cleaned"), (62, 51, 0, "the pump\nSite North TX-7 Data Sheet\nis cleaned"), (63, 51, 1, "the pump\nTX-2 Roll of Fans · Rev B\nis cleaned")]
    chunks = spark.createDataFrame([*common, own, *pages], CHUNKS)
    got = rows(scans.found(chunks, docs), "chunk_id", "kind", "item")
    assert [r for r in got if r[1] != "misread"] == [(61, "header", "TX-2 Ledger of Valves · Rev B"), (61, "split", "shielded"), (62, "header", "Site North TX-7 Data Sheet")]
    text = {r.chunk_id: r.text for r in scans.repaired(chunks, docs).collect()}
    assert text[61] == "the shielded pump is cleaned" and text[62] == "the pump is cleaned" and "Roll of Fans" in text[63]


def test_p3_automaton_finds_all_words_within_the_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a):
            prev, d[0] = d[0], i + 1
            for j, y in enumerate(b):
                prev, d[j + 1] = d[j + 1], min(prev + (x != y), d[j] + 1, d[j + 1] + 1)
        return d[-1]

    rng = random.Random(6)
    vocabulary = {"".join(rng.choices("abc", k=rng.randrange(1, 7))) for _ in range(200)}
    trie = scans.Trie(vocabulary)
    for _ in range(60):
        t = "".join(rng.choices("abcd", k=rng.randrange(1, 7)))
        for k in (1, 2):
            assert dict(trie.within(t, k)) == {w: distance(t, w) for w in vocabulary if distance(t, w) <= k}


def test_null_ids_and_clashing_columns_are_harmless(spark):
    long = " ".join(f"w{i}" for i in range(40))
    c = spark.createDataFrame([(None, 1, 0, long), (1, None, None, long), (2, 1, None, long + " tail"), (None, None, None, None)], CHUNKS)
    for name in ("id", "w", "h", "key", "kind", "a", "b", "rep", "token", "doc", "host", "t"):
        c = c.withColumn(name, F.lit("x"))
    assert rows(copies.copies(c), "chunk_id_a", "chunk_id_b") == []
    assert rows(near.found(c), "chunk_id_a", "chunk_id_b") == [(1, 2)]
    assert pieces.pieces(c, 50, 10).select("chunk_id").distinct().count() == 2
    d = c.select(F.col("chunk_id").alias("doc_id"), "text", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("extractor"), "id", "w", "h", "kind", "a", "b", "host", "t")
    assert encode.ids(d).count() == 4 and residue.found(d).count() == 0
    assert scans.found(c, d).count() == 0
    g = spark.createDataFrame([("g", long, None), (None, long, long)], "gold_id string, q string, passage string")
    assert rows(leaks.leaked(d, g), "doc_id", "gold_id") == [(1, "g"), (2, "g")]
    p = spark.createDataFrame([(None, 1, None), (5, None, None), (6, 1, None)], "pending_id long, batch_id int, sha256 string")
    s = spark.createDataFrame([(None, long), (5, long), (6, None)], "pending_id long, text string")
    assert rows(history.found(d, p, s), "pending_id", "kind") == [(5, "near")]
