"""Batched retrieval: many queries in one plan, keyed by query_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import cut, once, parts, small, together
from .revisions import revision, stem

K1, B, IDF_FLOOR, RRF_K = 1.2, 0.75, 1e-6, 60
#: Queries and vectors of one block.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
#: Names too general to boost by.
STOPWORDS = (
    "system systems cable panel control manual drawing unit general battery power supply module sensor device equipment "
    "switchboard facility asset electrical installation monitor monitoring"
).split()


def pool_size(k: int) -> int:
    return max(4 * k, 20)


# ---- lexical arm -------------------------------------------------------------------------------------------------


def phrases(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, times): every token of a query is a phrase of index terms; a repeated token counts again."""
    token = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_./-]+"), F.lit(0))).alias("token")
    terms = T.lexical_terms(F.col("token"))
    return queries.select("query_id", token).select("query_id", F.array_join(terms, " ").alias("phrase"), F.size(terms).alias("n")).where("n > 0").groupBy("query_id", "phrase").agg(F.count("*").alias("times"))


def _ngrams(terms: Column, n: int) -> Column:
    if n == 1:
        return terms

    def of(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))

    return T.let(terms, of)


def weights(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, phrase, part): what each wanted phrase adds to the score of each chunk that holds it, by BM25 over the whole index.

    Null texts are empty. A chunk's terms are told once; only those that begin a wanted phrase leave the explode, and phrases
    of several words are compared where they begin.
    """
    first = F.substring_index("phrase", " ", 1)
    vocabulary = small(cut(wanted.select("phrase", first.alias("term"), (F.size(F.split("phrase", " "))).alias("n")).distinct()))
    docs = cut(once(chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", T.lexical_terms(F.coalesce("text", F.lit(""))).alias("terms")))
    stats = docs.agg(F.count("*").alias("docs"), F.avg(F.size("terms")).alias("avgdl"))
    begun = docs.select("chunk_id", F.size("terms").alias("dl"), "terms", F.posexplode("terms").alias("pos", "term")).join(vocabulary, "term")
    told = begun.where((F.col("n") == 1) | (F.array_join(F.slice("terms", F.col("pos") + 1, F.col("n")), " ") == F.col("phrase")))
    tf = cut(told.groupBy("chunk_id", "phrase", "dl").agg(F.count("*").alias("f")))
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
    norm = F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    return tf.join(F.broadcast(stats)).join(small(cut(df)), "phrase").select("chunk_id", "phrase", (weight * F.col("f") * (K1 + 1) / norm).alias("part"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int, eligible: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query that share a phrase with it, score to six places, ties by id.

    queries: (query_id, text); chunks: (chunk_id, text); eligible: (chunk_id), of which alone chunks are ranked. The chunks are
    dealt over the tasks with their phrases; blocks of queries are scored against all chunks of a task at once, phrase by
    phrase, and only k of them for each query leave it.
    """
    wanted = cut(phrases(queries))
    parts_ = weights(wanted, chunks)
    hits = (parts_ if eligible is None else parts_.join(eligible, "chunk_id", "left_semi")).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.xxhash64("phrase").alias("h"), "part")
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = wanted.groupBy("query_id").agg(F.collect_list(F.struct(F.xxhash64("phrase").alias("h"), F.col("times"))).alias("m"))

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BLOCK):
                q, m = (c.slice(at, QUERY_BLOCK) for c in b.columns)
                flat = m.flatten()
                values = [m.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), flat.field("h").to_numpy(), flat.field("times").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array([q.to_pylist()], pa.list_(q.type)), *[pa.array([np.ascontiguousarray(v).tobytes()]) for v in values]], names=["q", "n", "h", "times"])

    blocks = small(cut(asked.mapInArrow(pack, f"q array<{kind}>, n binary, h binary, times binary")))

    def gather(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            ids, chunk = np.unique(t.column(0).to_numpy(), return_inverse=True)
            h = t.column(1).to_numpy()
            order = np.argsort(h, kind="stable")
            values = [ids, h[order], chunk[order].astype(np.int64), t.column(2).to_numpy()[order]]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()]) for v in values], names=["ids", "ph", "chunk", "part"])

    def score(batches):
        for b in batches:
            for r in range(b.num_rows):
                col = lambda c, kind=np.int64: np.frombuffer(b.column(b.schema.get_field_index(c))[r].as_py(), kind)  # noqa: B023, E731
                ids, ph, chunk, part = col("ids"), col("ph"), col("chunk"), col("part", np.float64)
                q, n, h, times = b.column(b.schema.get_field_index("q"))[r].values, col("n"), col("h"), col("times")
                lo, hi, end = np.searchsorted(ph, h), np.searchsorted(ph, h, side="right"), np.cumsum(n)
                at, who, what = [], [], []
                for i in range(len(n)):
                    s = np.zeros(len(ids))
                    for j in range(end[i] - n[i], end[i]):
                        s[chunk[lo[j] : hi[j]]] += part[lo[j] : hi[j]] * times[j]
                    met = np.flatnonzero(s)
                    if len(met) > k:  # ids are sorted, so of equally good chunks the first stay
                        near = np.rint(s[met] * 1e6)
                        least = -np.partition(-near, k - 1)[k - 1]
                        better = np.flatnonzero(near > least)
                        met = met[np.r_[better, np.flatnonzero(near == least)[: k - len(better)]]]
                    at.append(np.full(len(met), i))
                    who.append(ids[met])
                    what.append(s[met])
                if at:
                    yield pa.RecordBatch.from_arrays([q.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(who)), pa.array(np.concatenate(what))], names=["query_id", "chunk_id", "score"])

    dealt = hits.repartition(parts(queries.sparkSession), "chunk_id").mapInArrow(gather, "ids binary, ph binary, chunk binary, part binary")
    scored = dealt.crossJoin(blocks).mapInArrow(score, f"query_id {kind}, chunk_id long, score double")
    return top(scored.withColumn("score", F.round("score", 6)), k)


def top(scores: DataFrame, k: int, order: str = "desc", name: str = "rank", by: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best of each query with their 1-based rank; ties by id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(by) if order == "desc" else F.asc(by), tie)
    return scores.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


# ---- vector arm ----------------------------------------------------------------------------------------------------

# A stated set of queries meets all vectors in blocks: the vectors are packed where they lie, the queries are packed into
# blocks and sent to them (only where they are proven small; else partitions of both are paired), and every task keeps running
# results for each block of queries, so that what leaves a task doesn't grow with its vectors.

_PACK = "ids binary, x binary, dim int"


def _packed(rows: DataFrame, names: tuple[str, str], size: int) -> DataFrame:
    """Rows (id, vector) as blocks of at most ``size``, sorted by id; vectors that are null or hold a null are left out, as are those of
    another length than the first of their batch has (see ``distances``)."""

    def work(batches):
        for b in batches:
            ok = pc.and_(b.column(0).is_valid(), b.column(1).is_valid())
            ids, v = b.column(0).filter(ok), b.column(1).filter(ok)
            for dim in np.unique(v.value_lengths().to_numpy(zero_copy_only=False)):
                same = pc.equal(v.value_lengths(), int(dim))
                i, flat = ids.filter(same).to_numpy(), v.filter(same).flatten()
                x = flat.to_numpy(zero_copy_only=False).reshape(-1, int(dim)) if dim else np.zeros((len(i), 0))
                whole = ~np.isnan(x).any(1)
                i, x = i[whole], x[whole]
                order = np.argsort(i, kind="stable")
                for at in range(0, len(i), size):
                    o = order[at : at + size]
                    yield pa.RecordBatch.from_arrays([pa.array([i[o].tobytes()]), pa.array([np.ascontiguousarray(x[o]).tobytes()]), pa.array([int(dim)], pa.int32())], names=["ids", "x", "dim"])

    return rows.select(F.col(names[0]).cast("long"), F.col(names[1]).cast("array<double>")).mapInArrow(work, _PACK)


def micro(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of m (queries) to those of x in millionths, rounded: by a matrix product, and once more by
    differences where the product's error could be seen."""
    xx, mm = (x * x).sum(1), (m * m).sum(1)
    d2 = mm[:, None] + xx[None] - 2 * (m @ x.T)
    r, c = np.nonzero(d2 <= 1e-5 * (mm[:, None] + xx[None]))
    for at in range(0, len(r), 100_000):
        i, j = r[at : at + 100_000], c[at : at + 100_000]
        d2[i, j] = ((x[j] - m[i]) ** 2).sum(1)
    return np.rint(np.sqrt(np.maximum(d2, 0)) * 1e6).astype(np.int64)


def _joined(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each block of queries with each block of vectors of the same length."""
    return vectors.join(small(queries.withColumnRenamed("dim", "q_dim")), F.col("dim") == F.col("q_dim"))


def _arrays(b: pa.RecordBatch, k: int, names: list[str]):
    """Block k of a batch as arrays: integers, but for those of vectors."""
    cols = [b.column(b.schema.get_field_index(n))[k].as_py() for n in names]
    dim = b.column(b.schema.get_field_index("dim"))[k].as_py()
    return [np.frombuffer(c).reshape(-1, dim) if n in ("x", "qx") else np.frombuffer(c, np.int64) for n, c in zip(names, cols)]


def distances(queries: DataFrame, vectors: DataFrame, most: int) -> DataFrame:
    """(query_id, chunk_id, distance): Euclidean distances in double, rounded to six places, of at least the ``most`` nearest (ties by id).

    queries: (query_id, vector) and vectors: (chunk_id, vector); vectors of another length than the query's are no neighbours,
    null ones and such with nulls or NaN are left out. Every task gives ``most`` for each query, however many vectors it holds.
    """
    q = cut(_packed(queries.repartition(max(1, min(parts(queries.sparkSession), 64))), ("query_id", "vector"), QUERY_BLOCK)).select(F.col("ids").alias("q"), F.col("x").alias("qx"), "dim")

    def work(batches):
        best: dict = {}
        for b in batches:
            for k in range(b.num_rows):
                ids, x, q, m = _arrays(b, k, ["ids", "x", "q", "qx"])
                d = micro(x, m)
                keep = min(most, len(ids))
                place = np.argpartition((d << 13) + np.arange(len(ids)), keep - 1, axis=1)[:, :keep]  # ids are sorted, so places break ties
                i, d = ids[place], np.take_along_axis(d, place, 1)
                name = (m.shape[1], q.tobytes())
                if name in best:
                    i, d = np.concatenate([best[name][0], i], 1), np.concatenate([best[name][1], d], 1)
                    place = np.lexsort((i, d), axis=1)[:, :most]
                    i, d = np.take_along_axis(i, place, 1), np.take_along_axis(d, place, 1)
                best[name] = i, d
        for (_, q), (i, d) in best.items():
            q = np.repeat(np.frombuffer(q, np.int64), i.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(i.ravel()), pa.array(d.ravel() / 1e6)], names=["query_id", "chunk_id", "distance"])

    return _joined(q, _packed(vectors, ("chunk_id", "vector"), VECTOR_BLOCK)).select("ids", "x", "dim", "q", "qx").mapInArrow(work, "query_id long, chunk_id long, distance double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query with rank from 1; ties by id."""
    return top(distances(queries, vectors, k), k, "asc", by="distance")


def counted(queries: DataFrame, vectors: DataFrame, marks: DataFrame) -> DataFrame:
    """marks (query_id, chunk_id, distance) with g, the global rank: one more than the vectors nearer to the query (ties by id)."""
    told = marks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.round(F.col("distance") * 1e6).cast("long").alias("d"), F.col("chunk_id").alias("id")))).alias("m"))
    held = queries.join(told, "query_id").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), "m")

    def pack(batches):
        for b in batches:
            for dim in np.unique(b.column(1).value_lengths().to_numpy(zero_copy_only=False)):
                rows = np.flatnonzero(b.column(1).value_lengths().to_numpy(zero_copy_only=False) == dim)
                for at in range(0, len(rows), QUERY_BLOCK):
                    r = pa.array(rows[at : at + QUERY_BLOCK])
                    q, x, m = (b.column(c).take(r) for c in range(3))
                    n = m.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = m.flatten()
                    values = [q.to_numpy(), x.flatten().to_numpy(zero_copy_only=False), n, flat.field("d").to_numpy(), flat.field("id").to_numpy()]
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()]) for v in values] + [pa.array([int(dim)], pa.int32())], names=["q", "qx", "n", "d", "id", "dim"])

    q = cut(held.mapInArrow(pack, "q binary, qx binary, n binary, d binary, id binary, dim int"))

    def work(batches):
        sums: dict = {}
        for b in batches:
            for k in range(b.num_rows):
                ids, x, q, m, n, d, own = _arrays(b, k, ["ids", "x", "q", "qx", "n", "d", "id"])
                begin = np.cumsum(n) - n
                wide = np.int64(2**44)  # distances are below 2^44 millionths
                row = np.repeat(np.arange(len(q)), n)
                keys, far = row * wide + np.minimum(d, wide - 1), d[begin + n - 1]
                name = (m.shape[1], q.tobytes())
                have = sums.setdefault(name, (np.zeros(len(d) + 1, np.int64), n, d, own))[0]
                for at in range(0, len(q), 64):
                    block = micro(x, m[at : at + 64])
                    r, c = np.nonzero(block <= far[at : at + 64, None])
                    v, i = block[r, c], ids[c]
                    r = r + at
                    j, end = np.searchsorted(keys, r * wide + v), (begin + n)[r]
                    while True:  # of marks just as far, those with a smaller id are before the vector
                        tie = j < end
                        tie[tie] = (d[j[tie]] == v[tie]) & (own[j[tie]] <= i[tie])
                        if not tie.any():
                            break
                        j = j + tie
                    have += np.bincount(j[j < end], minlength=len(have))
        for (_, q), (have, n, d, own) in sums.items():
            total = np.cumsum(have[:-1])
            begin = np.cumsum(n) - n
            total -= np.repeat(np.where(begin > 0, total[begin - 1], 0), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(q, np.int64), n)), pa.array(own), pa.array(total)], names=["query_id", "chunk_id", "nearer"])

    met = _joined(q, _packed(vectors, ("chunk_id", "vector"), VECTOR_BLOCK)).select("ids", "x", "dim", "q", "qx", "n", "d", "id")
    nearer = met.mapInArrow(work, "query_id long, chunk_id long, nearer long").groupBy("query_id", "chunk_id").agg((F.sum("nearer") + 1).alias("g"))
    return marks.join(nearer, ["query_id", "chunk_id"])


def eligible_arm(queries: DataFrame, vectors: DataFrame, eligible: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, distance, pos): the eligible rows an over-fetch that doubles until it has a full pool would hold.

    The fetch starts at max(pool, 8k) rows of all and doubles until pool eligible rows are among them; the arm is every
    eligible row of the last fetch, pos counts from 0. Only distances of eligible rows are ranked; how far down among all
    rows one of them stands is counted. The nearest 4 pools of eligible rows serve nearly all queries; for the others four times
    as many are taken until the last fetch surely holds no more.
    """
    pool = pool_size(k)
    first, total = max(pool, 8 * k), vectors.count()
    mine = vectors.join(small(eligible.select("chunk_id").distinct()), "chunk_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    out, rest, many = None, queries, 4 * pool
    while True:
        near = distances(rest, mine, many).withColumn("e", F.row_number().over(w)).where(F.col("e") <= many)
        ranked = cut(counted(rest, vectors, cut(near)))
        need = ranked.groupBy("query_id").agg(F.min(F.when(F.col("e") >= pool, F.col("g"))).alias("need"), F.max("e").alias("e_last"), F.max("g").alias("g_last"))
        doubled = (first * F.pow(F.lit(2.0), F.greatest(F.lit(0.0), F.ceil(F.log2(F.col("need") / first))))).cast("long")
        reach = need.withColumn("reach", F.when(F.col("need").isNull(), F.lit(total)).otherwise(F.least(F.lit(total), doubled)))
        reach = cut(reach.withColumn("whole", (F.col("e_last") < many) | (F.col("g_last") >= F.col("reach"))))
        arm = ranked.join(small(reach.where("whole").select("query_id", "reach")), "query_id").where(F.col("g") <= F.col("reach"))
        arm = arm.select("query_id", "chunk_id", "distance", (F.col("e") - 1).cast("int").alias("pos"))
        out = arm if out is None else out.union(arm)
        left = reach.where("not whole").select("query_id")
        if left.isEmpty():
            return out
        rest, many = queries.join(small(left), "query_id", "left_semi"), 4 * many


# ---- fusion ---------------------------------------------------------------------------------------------------------


def fuse(vector_arm: DataFrame, lexical_arm: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, vec_pos, lex_pos): the sum of 1 / (rrf_k + position) over the arms, positions from 0."""
    v = vector_arm.select("query_id", "chunk_id", F.col("pos").alias("vec_pos"))
    t = lexical_arm.select("query_id", "chunk_id", F.col("pos").alias("lex_pos"))
    part = lambda c: F.coalesce(1 / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    return v.join(t, ["query_id", "chunk_id"], "full").withColumn("score", part("vec_pos") + part("lex_pos"))


def ordered(fused: DataFrame, k: int) -> DataFrame:
    """The k best with rank from 1 and score to six places; ties go by position in the vector arm, then in the lexical arm."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_pos"), F.asc_nulls_last("lex_pos"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("score", 6))


def eligible_chunks(chunks: DataFrame, documents: DataFrame, domains: list[str] | None = None, superseded: DataFrame | None = None) -> DataFrame:
    """chunk_id of documents in the domains (all, if None) whose rel_path isn't superseded."""
    docs = documents if domains is None else documents.where(F.col("domain").isin(domains))
    if superseded is not None:
        docs = docs.join(small(superseded.select("rel_path").distinct()), "rel_path", "left_anti")
    return chunks.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").select("chunk_id").distinct()


def aliases(equipment: DataFrame, links: DataFrame, least: int = 6) -> DataFrame:
    """(alias, document_id): lower-cased canonical names and aliases of at least six characters that aren't stop words.

    Aliases are normalised like queries (runs of other characters become one space), so that a hyphened alias can match.
    """
    names = F.array_append(F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>")), F.col("canonical_name"))
    flat = equipment.select("equipment_id", F.explode(names).alias("raw")).where("raw is not null")
    clean = flat.select("equipment_id", plain(F.col("raw")).alias("alias")).where((F.length("alias") >= least) & ~F.col("alias").isin(STOPWORDS))
    return clean.join(links.dropna().distinct(), "equipment_id").select("alias", "document_id").distinct()


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def boosted_documents(queries: DataFrame, alias_map: DataFrame) -> DataFrame:
    """(query_id, document_id) of the documents linked to an alias that stands in the query as whole words.

    An equi-join: each run of words of the query, up to the longest alias, is looked up.
    """
    longest = alias_map.agg(F.max(F.size(F.split("alias", " ")))).first()[0] or 0
    if not longest:
        return queries.select("query_id", F.lit(None).cast("long").alias("document_id")).limit(0)
    w = F.split(plain(F.col("text")), " ")
    runs = F.flatten(F.array(*[_ngrams(w, n) for n in range(1, longest + 1)]))
    return queries.select("query_id", F.explode(F.array_distinct(runs)).alias("alias")).join(alias_map, "alias").select("query_id", "document_id").distinct()


def boost(fused: DataFrame, chunks: DataFrame, boosted: DataFrame, weight: float = 0.01) -> DataFrame:
    """Adds the weight once to fused chunks of a boosted document; never adds candidates."""
    home = chunks.select("chunk_id", "document_id").dropDuplicates(["chunk_id"])
    marked = fused.join(home, "chunk_id", "left").join(boosted.withColumn("hit", F.lit(True)), ["query_id", "document_id"], "left")
    return marked.withColumn("score", F.col("score") + F.when(F.col("hit"), F.lit(weight)).otherwise(0.0)).drop("hit")


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 8, mode: str = "hybrid", eligible: DataFrame | None = None, boosted: DataFrame | None = None, weight: float = 0.01) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, text, vector); mode is vector, fts or hybrid.

    Eligibility is applied before ranking. The vector arm is as long as an over-fetch would make it, the lexical arm is
    cut to the pool.
    """
    pool = pool_size(k)
    q = queries.select("query_id", "vector") if mode != "fts" else None

    def vector_arm():
        return nearest(q, vectors, pool).withColumn("pos", F.col("rank") - 1) if eligible is None else eligible_arm(q, vectors, eligible, k)

    def lexical_arm():
        return bm25(queries.select("query_id", "text"), chunks, pool, eligible).withColumn("pos", F.col("rank") - 1)

    if mode == "hybrid":
        arm, lex = together(vector_arm, lexical_arm)
    elif mode == "vector":
        arm = vector_arm()
        lex = arm.limit(0)
    else:
        lex = lexical_arm()
        arm = lex.limit(0)
    fused = fuse(arm, lex)
    if mode == "hybrid" and boosted is not None:
        fused = boost(fused, chunks, boosted, weight)
    return ordered(fused, k).select("query_id", "chunk_id", "score", "rank")


def hydrated(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with the text of their chunk, the names of their document and its revision; only the hits' rows are fetched.

    The family of a revision is its folder and the stem of its name; what the index holds is the current state.
    """
    c = chunks.select("chunk_id", "document_id", "text").dropDuplicates(["chunk_id"])
    d = documents.select(F.col("doc_id").alias("document_id"), "source", "rel_path", "domain", "sha256")
    base, parent = F.regexp_extract("rel_path", "([^/]*)$", 1), F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    out = hits.join(c, "chunk_id").join(d, "document_id").withColumn("parent_path", parent).withColumn("rev", revision(base))
    family = F.when(F.col("rev").isNotNull(), F.concat(parent, F.lit("/"), stem(base)))
    return out.withColumn("revision_label", F.col("rev.label")).withColumn("revision_family", family).withColumn("revision_state", F.lit("current")).drop("rev")


# ---- reranking -----------------------------------------------------------------------------------------------------


def listed_passages(candidates: DataFrame, pool: int = 15, chars: int = 300) -> DataFrame:
    """(query_id, n, passages): what a list-wise reranker is shown of each query's first ``pool`` candidates (query_id, pos from 1, source, text):
    numbered lines with the source and the first characters of the text."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] ("), F.coalesce("source", F.lit("")), F.lit(") "), F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, chars), "\\n", " "))
    shown = candidates.where(F.col("pos") <= pool).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return shown.select("query_id", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("passages"))


def permuted(candidates: DataFrame, replies: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) after a list-wise reply such as ``[3, 1, 2]``.

    Numbers out of range and repetitions are dropped, candidates not named follow in their order; an unreadable or missing
    reply leaves the order. candidates: (query_id, chunk_id, pos from 1); replies: (query_id, reply).
    """
    listed = F.regexp_extract_all(F.regexp_extract("reply", "\\[([^\\[\\]]*)\\]", 1), F.lit("\\d+"), F.lit(0))
    said = replies.select("query_id", F.posexplode(listed).alias("at", "n")).select("query_id", "at", F.expr("try_cast(n as bigint)").alias("pos")).groupBy("query_id", "pos").agg(F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("at"), "pos")
    return candidates.join(said, ["query_id", "pos"], "left").withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "rank")


def rescored(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank) by a service's scores, one per candidate, in a stable descending order.

    A list of another length than the candidates', or with a null, leaves the order. scores: (query_id, scores array).
    """
    n = candidates.groupBy("query_id").agg(F.count("*").alias("n"))
    fit = scores.join(n, "query_id").where((F.size("scores") == F.col("n")) & ~F.exists("scores", lambda x: x.isNull())).select("query_id", "scores")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("s"), "pos")
    return candidates.join(fit, "query_id", "left").withColumn("s", F.expr("try_element_at(scores, cast(pos as int))")).withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "rank")
