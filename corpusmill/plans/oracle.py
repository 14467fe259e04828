"""The catalogue's queries in SQL, written for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.text import ACCENTED, DASHES, PLAIN, QUOTES
from ..operators.audit import SECRET_NAMES, SECRETS
from ..operators.dedupe import SEEDS
from ..operators.entities import LEGAL, NOTHING, TAG
from ..operators.evaluation import FAILURES, REFUSALS
from ..operators.ledger import EXTENSIONS, TERMINAL
from ..operators.retrieval import STOPWORDS

TAXONOMY = ["10_power", "20_cooling", "30_water", "40_fire", "50_controls", "60_lifts", "70_procedures", "80_civil", "99_misc"]
NOW, STALE_DAYS = "2026-01-01 00:00:00", 365
ACTIONS = {"view": "error", "click": "retry", "purchase": "processed", "signup": "retry_requested", "error": "skip_unsafe"}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(lit(x) for x in items)


WHITE = "[\\t\\n\\x0B\\f\\r\\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def norm(x: str) -> str:
    return f"coalesce(array_to_string(regexp_extract_all(lower({x}), '[a-z0-9]+'), ' '), '')"


def terms(x: str) -> str:
    return f"regexp_extract_all(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


def ngrams(t: str, n: int) -> str:
    return f"[array_to_string({t}[i:i + {n - 1}], ' ') for i in range(1, greatest(len({t}) - {n - 2}, 1))]"


def ascii_(x: str) -> str:
    quotes = QUOTES
    ascii_quotes = "''''\"\""  # two escaped single quotes and two double ones
    return f"translate({x}, '{DASHES}{quotes}', '{'-' * len(DASHES)}{ascii_quotes}')"


CHUNKS = "c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, seq, text FROM chunks)"


def bm25(queries: str, eligible: str = "") -> str:
    """CTEs that end in bm(query_id, chunk_id, score); ``queries`` selects (query_id, text), CTE c must be there."""
    only = f"WHERE chunk_id IN (SELECT chunk_id FROM {eligible})" if eligible else ""
    return f"""
q AS ({queries}),
qt AS (SELECT query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./-]+')) AS token FROM q),
qp AS (SELECT query_id, array_to_string(t, ' ') AS phrase, len(t) AS n, count(*) AS times FROM (SELECT query_id, {terms('token')} AS t FROM qt) WHERE len(t) > 0 GROUP BY ALL),
ct AS (SELECT chunk_id, {terms("coalesce(text, '')")} AS t FROM c),
st AS (SELECT count(*) AS docs, avg(len(t)) AS avgdl FROM ct),
lens AS (SELECT DISTINCT n FROM qp),
grams AS (SELECT chunk_id, len(t) AS dl, n, unnest([array_to_string(t[i:i + n - 1], ' ') for i in range(1, greatest(len(t) - n + 2, 1))]) AS phrase FROM ct, lens),
tf AS (SELECT chunk_id, phrase, dl, count(*) AS f FROM grams WHERE phrase IN (SELECT phrase FROM qp) GROUP BY ALL),
df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT phrase, CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((docs - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
bm AS (SELECT query_id, chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) * times), 6) AS score
  FROM (SELECT * FROM tf {only}) tf JOIN w USING (phrase) JOIN qp USING (phrase), st GROUP BY ALL)"""


USABLE = "v AS (SELECT DISTINCT ON (chunk_id) chunk_id, embedding::DOUBLE[] AS vector FROM vchunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)"
RANKED_ITEMS = """
v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS vector, label FROM embeddings),
d AS (SELECT x.chunk_id AS query_id, y.chunk_id, y.label, round(list_distance(x.vector, y.vector), 6) AS distance FROM v x, v y WHERE x.chunk_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM d)"""
GOLD_QUERIES = "SELECT gold_id AS query_id, q AS text FROM gold WHERE q IS NOT NULL"
HYBRID_QUERIES = "SELECT c.chunk_id AS query_id, dd.summary AS text FROM c JOIN v USING (chunk_id) JOIN documents dd ON dd.doc_id = c.document_id WHERE c.chunk_id % 20 = 0 AND dd.summary IS NOT NULL"
CANDIDATES = RANKED_ITEMS + ", cand AS (SELECT query_id, chunk_id, rank AS pos FROM r WHERE rank <= 8)"

PARSED = r"""
b AS (SELECT *, regexp_extract(rel_path, '([^/]*)$', 1) AS base, regexp_extract(rel_path, '^(.*)/[^/]*$', 1) AS parent FROM documents WHERE rel_path IS NOT NULL),
m AS (SELECT *, lower(regexp_extract(base, '[^.](\.[^.]*)$', 1)) AS ext,
  regexp_extract(base, '(?i)(?:^|[^A-Za-z])rev[\s._-]*([A-Za-z])(\d*)\b', ['l', 'n']) AS a, regexp_matches(base, '(?i)(?:^|[^A-Za-z])rev[\s._-]*([A-Za-z])(\d*)\b') AS is_a,
  regexp_extract(base, '(?i)(?:^|[^A-Za-z])rev[\s._-]*(\d+)\b', 1) AS num, regexp_matches(base, '(?i)(?:^|[^A-Za-z])rev[\s._-]*(\d+)\b') AS is_n,
  regexp_extract(base, '(?i)(?:^|[^A-Za-z])v\.?\s*(\d+)\.(\d+)\b', ['x', 'y']) AS ver, regexp_matches(base, '(?i)(?:^|[^A-Za-z])v\.?\s*(\d+)\.(\d+)\b') AS is_v,
  regexp_extract(base, '\b(\d{2})[-_.](\d{2})[-_.](20\d{2})\b', ['d', 'm', 'y']) AS day, regexp_matches(base, '\b(\d{2})[-_.](\d{2})[-_.](20\d{2})\b') AS is_d,
  regexp_extract(base, '\b(20\d{6})\b', 1) AS d8, regexp_matches(base, '\b(20\d{6})\b') AS is_8,
  regexp_extract(base, '\((\d+)\)', 1) AS cp, regexp_matches(base, '\((\d+)\)') AS is_c FROM b),
k AS (SELECT *,
  CASE WHEN is_a THEN 'rev-letter' WHEN is_n THEN 'rev-num' WHEN is_v THEN 'version' WHEN is_d OR is_8 THEN 'date' WHEN is_c THEN 'copy' END AS kind,
  CASE WHEN is_a THEN 'rev' || a.l || a.n WHEN is_n THEN 'rev' || num WHEN is_v THEN 'v' || ver.x || '.' || ver.y WHEN is_d THEN day.d || '-' || day.m || '-' || day.y WHEN is_8 THEN d8 WHEN is_c THEN '(' || cp || ')' END AS label,
  CASE WHEN is_a THEN [ascii(upper(a.l))::BIGINT, coalesce(try_cast(a.n AS BIGINT), 0)] WHEN is_n THEN [num::BIGINT] WHEN is_v THEN [ver.x::BIGINT, ver.y::BIGINT]
    WHEN is_d THEN [(day.y || day.m || day.d)::BIGINT] WHEN is_8 THEN [d8::BIGINT] WHEN is_c THEN [cp::BIGINT] END AS sortkey,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    base, '([^.])\.[^.]*$', '\1'),
    '(?i)(^|[^A-Za-z])rev[\s._-]*([A-Za-z])(\d*)\b', '\1 ', 'g'), '(?i)(^|[^A-Za-z])rev[\s._-]*(\d+)\b', '\1 ', 'g'), '(?i)(^|[^A-Za-z])v\.?\s*(\d+)\.(\d+)\b', '\1 ', 'g'),
    '\b(\d{2})[-_.](\d{2})[-_.](20\d{2})\b', ' ', 'g'), '\b(20\d{6})\b', ' ', 'g'), '\((\d+)\)', ' ', 'g'), '[ _.\-]+', ' ', 'g'))) AS stem FROM m),
p AS (SELECT * FROM k WHERE kind IS NOT NULL AND length(stem) >= 6)"""
FAMILIES = PARSED + f""",
t AS (SELECT p.*, coalesce({norm('p.text')}, '') AS nt, coalesce(p.n_chunks, 0) AS nc, coalesce(p.domain, '') AS dom FROM p),
o AS (SELECT *, row_number() OVER f AS place, count(*) OVER (PARTITION BY dom, parent, stem, ext, kind) AS size FROM t WINDOW f AS (PARTITION BY dom, parent, stem, ext, kind ORDER BY sortkey DESC, rel_path, doc_id)),
j AS (SELECT o.*, h.sortkey AS hk, h.nc AS hc, h.nt AS ht FROM o JOIN o h ON (o.dom, o.parent, o.stem, o.ext, o.kind) = (h.dom, h.parent, h.stem, h.ext, h.kind) AND h.place = 1 WHERE o.size > 1),
s AS (SELECT *, list_distinct(string_split(nt, ' ')) AS x, list_distinct(string_split(ht, ' ')) AS y FROM j),
u AS (SELECT *, CASE WHEN place = 1 THEN 'keep' WHEN sortkey = hk THEN 'held' WHEN nc > 2 * greatest(1, hc) THEN 'held' ELSE 'supersede' END AS verdict FROM s
  WHERE place = 1 OR NOT (length(nt) >= 300 AND length(ht) >= 300 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) < 0.2)),
fam AS (SELECT * FROM (SELECT *, count(*) FILTER (verdict <> 'keep') OVER (PARTITION BY dom, parent, stem, ext, kind) AS others FROM u) WHERE others > 0)"""

SIGNATURES = f"""
n AS (SELECT doc_id, {norm('text')} AS t FROM documents WHERE text IS NOT NULL),
tk AS (SELECT doc_id, string_split(t, ' ') AS w FROM n WHERE length(t) >= 300),
sh AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM tk),
hs AS (SELECT doc_id, list_sort([('0x' || substr(md5(x), 1, 8))::BIGINT for x in s])[1:800] AS h FROM sh),
sg AS (SELECT doc_id, [list_min([xor(x, seed) for x in h]) for seed in {SEEDS}] AS sig FROM hs)"""
NEAR = SIGNATURES + """,
reps AS (SELECT sig, min(doc_id) AS rep FROM sg GROUP BY sig),
bands AS (SELECT rep, sig, b, sig[b * 4 + 1:b * 4 + 4] AS rows FROM reps, range(16) AS g(b)),
met AS (SELECT DISTINCT x.rep AS a, y.rep AS b, x.sig AS sa, y.sig AS sb FROM bands x JOIN bands y ON x.b = y.b AND x.rows = y.rows AND x.rep < y.rep),
near AS (SELECT a, b, len(list_filter(list_zip(sa, sb), lambda z: z[1] = z[2])) / 64 AS similarity FROM met),
pairs AS (SELECT a, b, similarity FROM near WHERE similarity >= 0.8 UNION ALL SELECT rep, doc_id, 1.0 FROM sg JOIN reps USING (sig) WHERE doc_id <> rep)"""


def components(edges: str) -> str:
    """CTEs that end in comp(id, component) from ``edges`` (a, b)."""
    return f"""
both_ways AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
reach AS (SELECT a AS id, a AS node FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.node = both_ways.a),
comp AS (SELECT id, min(node) AS component FROM reach GROUP BY id)"""


LINKS = """
l AS (SELECT DISTINCT equipment_id AS e, document_id AS d FROM doc_equipment WHERE equipment_id IS NOT NULL AND document_id IS NOT NULL),
ln AS (SELECT e, count(*) AS n FROM l GROUP BY e),
sh AS (SELECT x.e AS a, y.e AS b, count(*) AS shared FROM l x JOIN l y ON x.d = y.d AND x.e < y.e GROUP BY ALL HAVING count(*) >= 3)"""
PROPOSED = LINKS + r""",
eq AS (SELECT DISTINCT ON (equipment_id) equipment_id, canonical_name AS name, coalesce(nullif(make, ''), nullif(model, '')) IS NULL AS bare,
  regexp_matches(trim(canonical_name), '^(.*?)(\d+)\s*$') AS num, lower(regexp_extract(trim(canonical_name), '^(.*?)(\d+)\s*$', 1)) AS head, regexp_extract(trim(canonical_name), '^(.*?)(\d+)\s*$', 2) AS tail FROM equipment),
prop AS (SELECT a, b, shared, round(shared / least(x.n, y.n), 2) AS ratio FROM sh JOIN ln x ON x.e = a JOIN ln y ON y.e = b JOIN eq p ON p.equipment_id = a JOIN eq q ON q.equipment_id = b
  WHERE shared / least(x.n, y.n) >= 0.3 AND NOT (p.bare AND q.bare) AND NOT (p.num AND q.num AND p.head = q.head AND p.tail <> q.tail)
  AND p.name IS NOT NULL AND q.name IS NOT NULL)"""
KEYS = f"""
l AS (SELECT DISTINCT equipment_id, document_id FROM doc_equipment WHERE equipment_id IS NOT NULL AND document_id IS NOT NULL),
e0 AS (SELECT DISTINCT ON (equipment_id) equipment_id, canonical_name AS name, coalesce(from_json(tags_json, '["VARCHAR"]'), []) AS tags, coalesce(from_json(aliases_json, '["VARCHAR"]'), []) AS syn,
  trim(regexp_replace(make, '\\s+', ' ', 'g')) AS mk, trim(regexp_replace(model, '\\s+', ' ', 'g')) AS md FROM equipment),
e1 AS (SELECT *, CASE WHEN mk <> '' AND NOT regexp_matches(mk, '^[{{\\[]') AND lower(mk) NOT IN ({listed(NOTHING)}) THEN mk END AS mk1,
  CASE WHEN md <> '' AND NOT regexp_matches(md, '^[{{\\[]') AND lower(md) NOT IN ({listed(NOTHING)}) THEN md END AS model FROM e0),
e2 AS (SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(mk1, '{LEGAL}', '', 'g'), '\\s+', ' ', 'g')), '^[ .,\\-]+|[ .,\\-]+$', '', 'g') AS mk2 FROM e1),
e3 AS (SELECT *, CASE WHEN mk2 = '' THEN mk1 ELSE mk2 END AS make FROM e2),
k0 AS (SELECT document_id, e3.* FROM l JOIN e3 USING (equipment_id)),
keys AS (
  SELECT document_id, 'make-model:' || lower(trim(regexp_replace(make || ' ' || model, '\\s+', ' ', 'g'))) AS key, name, syn, tags FROM k0 WHERE make IS NOT NULL AND model IS NOT NULL
  UNION ALL SELECT document_id, 'make-equipment:' || lower(trim(regexp_replace(make || ' ' || name, '\\s+', ' ', 'g'))), name, syn, tags FROM k0 WHERE make IS NOT NULL AND model IS NULL AND name IS NOT NULL
  UNION ALL SELECT document_id, 'tag:' || lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), name, syn, tags FROM (SELECT *, unnest(tags) AS t FROM k0) WHERE regexp_matches(trim(t), '{TAG}'))"""
FACTS = """
f0 AS (SELECT pending_id, max(sha256) AS sha256, max(rel_path) AS rel_path FROM ingest_pending GROUP BY 1),
f AS (SELECT pending_id, rel_path, sha256 IS NOT NULL AND sha256 IN (SELECT sha256 FROM documents WHERE sha256 IS NOT NULL) AS document, pending_id % 3 <> 0 AS curated, pending_id % 2 = 0 AS source FROM f0)"""
SECRET_LIST = "[x for x in [" + ", ".join(f"CASE WHEN regexp_matches(t, {lit(p)}) THEN {lit(n)} END" for n, p in SECRETS.items()) + "] if x IS NOT NULL]"
LATEST = "SELECT pending_id, arg_max({what}, (updated_at, state)) AS {name} FROM (SELECT DISTINCT pending_id, state, updated_at, batch_id FROM ingest_pending) GROUP BY 1"
ANSWERS = """
a AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' ELSE coalesce(summary, 'It is so') || CASE WHEN doc_id % 3 = 0 THEN ' [1]' ELSE '' END || ' and [' || (doc_id % 7) || ']' END AS answer, (doc_id % 5)::INT AS sources FROM documents),
n AS (SELECT *, [x::INT for x in regexp_extract_all(answer, '\\[(\\d+)\\]', 1)] AS numbers FROM a)"""

ALIASES = f"""raw AS (SELECT equipment_id, unnest(list_append(coalesce(from_json(aliases_json, '["VARCHAR"]'), []), canonical_name)) AS r FROM equipment),
        al AS (SELECT DISTINCT trim(regexp_replace(lower(r), '[^a-z0-9]+', ' ', 'g')) AS alias, document_id FROM raw JOIN doc_equipment USING (equipment_id) WHERE r IS NOT NULL AND document_id IS NOT NULL),
        ok AS (SELECT * FROM al WHERE length(alias) >= 6 AND alias NOT IN ({listed(STOPWORDS)}))"""

SQL = {
    "domain_stats": "SELECT domain, count(*) AS documents, coalesce(sum(n_chunks), 0) AS chunks FROM documents GROUP BY 1",
    "domain_zero_fill": f"""WITH k AS (SELECT unnest([{listed(TAXONOMY)}]) AS domain), n AS (SELECT domain, count(*) AS documents FROM documents WHERE domain IS NOT NULL GROUP BY 1)
        SELECT domain, coalesce(documents, 0) AS documents FROM k FULL JOIN n USING (domain)""",
    "corpus_totals": "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM equipment) AS equipment",
    "chunk_windows": "SELECT doc_id, i::INT AS seq, substr(text, i * 1600 + 1, 1800) AS chunk FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 1600 + 1)) AS i FROM documents WHERE length(text) > 0)",
    "chunk_packed": f"""
WITH p AS (SELECT doc_id, [x for x in [{strip('y')} for y in string_split_regex(text, '\\n[\\s\\x0B]*\\n')] if length(x) > 0] AS ps FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'open': ''}}, [{{'done': []::VARCHAR[], 'open': x}} for x in ps]), lambda a, p: {{
  'done': CASE WHEN length(p.open) > 1800 THEN list_concat(CASE WHEN a.open = '' THEN a.done ELSE list_append(a.done, a.open) END, [substr(p.open, i * 1600 + 1, 1800) for i in range(0, (length(p.open) - 1) // 1600 + 1)])
    WHEN a.open = '' OR length(a.open) + length(p.open) + 2 <= 1800 THEN a.done ELSE list_append(a.done, a.open) END,
  'open': CASE WHEN length(p.open) > 1800 THEN '' WHEN a.open = '' THEN p.open WHEN length(a.open) + length(p.open) + 2 <= 1800 THEN a.open || chr(10) || chr(10) || p.open ELSE p.open END}}) AS r FROM p),
d AS (SELECT doc_id, CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END AS cs FROM s)
SELECT doc_id, (i - 1)::INT AS seq, cs[i] AS chunk FROM (SELECT doc_id, cs, unnest(range(1, len(cs) + 1)) AS i FROM d)""",
    "source_reassembly": f"WITH {CHUNKS}, r AS (SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY seq, chunk_id) AS t FROM c WHERE text IS NOT NULL GROUP BY 1) SELECT document_id, md5(t) AS digest, length(t) AS n FROM r",
    "normalised_text": f"SELECT doc_id, md5(t) AS digest, length(t) AS n FROM (SELECT doc_id, {norm('text')} AS t FROM documents WHERE text IS NOT NULL)",
    "shingle_counts": f"""WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM n)
        SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)])) END AS n FROM w""",
    "exact_dup_groups": f"""WITH n AS (SELECT doc_id, {norm('text')} AS t FROM documents WHERE text IS NOT NULL)
        SELECT sha1(t) AS digest, count(*) AS members, min(doc_id) AS least_id FROM n WHERE length(t) > 40 GROUP BY 1 HAVING count(*) > 1""",
    "minhash_signatures": f"WITH {SIGNATURES} SELECT doc_id, md5(array_to_string(sig, ',')) AS digest FROM sg",
    "lsh_pairs": f"WITH {NEAR} SELECT a, b, similarity FROM pairs",
    "near_dup_clusters": f"""WITH RECURSIVE {NEAR}, ex AS (SELECT sha1(t) AS g, doc_id FROM n WHERE length(t) > 40), el AS (SELECT g, min(doc_id) AS a FROM ex GROUP BY 1),
edges AS (SELECT a, doc_id AS b FROM ex JOIN el USING (g) WHERE doc_id <> a UNION SELECT a, b FROM pairs),{components('edges')}
SELECT id AS doc_id, component AS cluster, count(*) OVER (PARTITION BY component) AS members FROM comp""",
    "revision_parse": f"WITH {PARSED} SELECT doc_id, stem, ext, parent, kind, label, sortkey[1] AS key1, sortkey[2] AS key2 FROM p",
    "revision_families": f"WITH {FAMILIES} SELECT doc_id, stem, kind, label, verdict FROM fam",
    "superseded_paths": f"WITH {FAMILIES} SELECT DISTINCT rel_path FROM fam WHERE verdict = 'supersede' AND rel_path NOT IN (SELECT rel_path FROM documents WHERE doc_id % 3 = 0 AND rel_path IS NOT NULL)",
    "bm25_topk": f"""WITH {CHUNKS}, {bm25(GOLD_QUERIES)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm)
        SELECT query_id, r.chunk_id, document_id, score, rank FROM r JOIN c USING (chunk_id) WHERE rank <= 10""",
    "knn_l2_topk": f"WITH {RANKED_ITEMS} SELECT query_id, chunk_id, distance, rank FROM r WHERE rank <= 10",
    "knn_eligible": f"""WITH {RANKED_ITEMS}, e AS (SELECT *, count(*) FILTER (label < 7) OVER (PARTITION BY query_id ORDER BY rank) AS e, count(*) OVER (PARTITION BY query_id) AS total FROM r),
        need AS (SELECT query_id, min(rank) FILTER (e >= 32) AS need, max(total) AS total FROM e GROUP BY 1),
        lim AS (SELECT query_id, CASE WHEN need IS NULL THEN total ELSE least(total, list_min([x for x in [64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072] if x >= need])) END AS reach FROM need)
        SELECT query_id, chunk_id, distance, (e - 1)::INT AS pos FROM e JOIN lim USING (query_id) WHERE label < 7 AND rank <= reach""",
    "rrf_fusion": f"""WITH {CHUNKS}, {USABLE}, {bm25(HYBRID_QUERIES)},
        ds AS (SELECT q.query_id, v.chunk_id, round(list_distance(x.vector, v.vector), 6) AS distance FROM q JOIN v x ON x.chunk_id = q.query_id, v),
        va AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1)::INT AS vec_pos FROM ds),
        la AS (SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS lex_pos FROM bm)
        SELECT query_id, chunk_id, round(coalesce(1 / (60 + vec_pos), 0) + coalesce(1 / (60 + lex_pos), 0), 6) AS score, vec_pos, lex_pos FROM (SELECT * FROM va WHERE vec_pos < 20) FULL JOIN (SELECT * FROM la WHERE lex_pos < 20) USING (query_id, chunk_id)""",
    "hybrid_search": f"""WITH {CHUNKS}, {USABLE}, ok AS (SELECT DISTINCT chunk_id FROM c JOIN documents ON doc_id = document_id WHERE domain IN ('10_power', '20_cooling', '30_water')), {bm25(HYBRID_QUERIES, 'ok')},
        ds AS (SELECT q.query_id, v.chunk_id, round(list_distance(x.vector, v.vector), 6) AS distance, v.chunk_id IN (SELECT chunk_id FROM ok) AS good FROM q JOIN v x ON x.chunk_id = q.query_id, v),
        g AS (SELECT *, row_number() OVER w AS g, count(*) FILTER (good) OVER w AS e FROM ds WINDOW w AS (PARTITION BY query_id ORDER BY distance, chunk_id)),
        need AS (SELECT query_id, min(g) FILTER (e >= 32) AS need, max(g) AS total FROM g GROUP BY 1),
        lim AS (SELECT query_id, CASE WHEN need IS NULL THEN total ELSE least(total, list_min([x for x in [64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072, 262144, 524288] if x >= need])) END AS reach FROM need),
        va AS (SELECT query_id, chunk_id, e - 1 AS vec_pos FROM g JOIN lim USING (query_id) WHERE good AND g <= reach),
        la AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS lex_pos FROM bm),
        fu AS (SELECT query_id, chunk_id, coalesce(1 / (60 + vec_pos), 0) + coalesce(1 / (60 + lex_pos), 0) AS score, vec_pos, lex_pos FROM va FULL JOIN (SELECT * FROM la WHERE lex_pos < 32) USING (query_id, chunk_id)),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_pos NULLS LAST, lex_pos NULLS LAST, chunk_id) AS rank FROM fu)
        SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM o WHERE rank <= 8""",
    "entity_boost": f"""WITH {CHUNKS}, {ALIASES},
        q AS (SELECT chunk_id AS query_id, text FROM c WHERE chunk_id % 20 = 0 AND text IS NOT NULL UNION ALL SELECT -equipment_id, 'Where is the manual of the ' || canonical_name || '?' FROM equipment WHERE canonical_name IS NOT NULL),
        p AS (SELECT query_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM q),
        names AS (SELECT DISTINCT alias FROM ok), hit AS (SELECT query_id, alias FROM p JOIN names ON contains(t, ' ' || alias || ' ')),
        bd AS (SELECT DISTINCT query_id, document_id FROM hit JOIN ok USING (alias))
        SELECT query_id, count(*) AS documents, min(document_id) AS least FROM bd GROUP BY 1""",
    "boosted_fusion": f"""WITH {CHUNKS}, {ALIASES}, {bm25("SELECT -equipment_id AS query_id, 'Where is the manual of the ' || canonical_name || '?' AS text FROM equipment WHERE canonical_name IS NOT NULL")},
        p AS (SELECT query_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM q), names AS (SELECT DISTINCT alias FROM ok),
        bd AS (SELECT DISTINCT query_id, document_id FROM p JOIN names ON contains(t, ' ' || alias || ' ') JOIN ok USING (alias)),
        la AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS lex_pos FROM bm),
        fu AS (SELECT la.query_id, la.chunk_id, lex_pos, 1 / (60 + lex_pos) + CASE WHEN bd.document_id IS NOT NULL THEN 0.012::DOUBLE ELSE 0 END AS score FROM la JOIN c USING (chunk_id) LEFT JOIN bd ON bd.query_id = la.query_id AND bd.document_id = c.document_id WHERE lex_pos < 20),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lex_pos, chunk_id) AS rank FROM fu)
        SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM o WHERE rank <= 8""",
    "hit_metadata": f"""WITH {CHUNKS}, {bm25(GOLD_QUERIES)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm), {PARSED}
        SELECT r.query_id, r.chunk_id, d.source, d.rel_path, d.sha256, regexp_extract(d.rel_path, '^(.*)/[^/]*$', 1) AS parent_path, k.label AS revision_label,
          CASE WHEN k.kind IS NOT NULL THEN k.parent || '/' || k.stem END AS revision_family, 'current' AS revision_state
        FROM r JOIN c USING (chunk_id) JOIN documents d ON d.doc_id = c.document_id LEFT JOIN k ON k.doc_id = d.doc_id WHERE rank <= 5""",
    "listed_passages": f"""WITH {CHUNKS}, {bm25(GOLD_QUERIES)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm),
        l AS (SELECT r.query_id, rank, '[' || rank || '] (' || coalesce(d.source, '') || ') ' || replace(substr(coalesce(c.text, ''), 1, 300), chr(10), ' ') AS line FROM r JOIN c USING (chunk_id) JOIN documents d ON d.doc_id = c.document_id WHERE rank <= 15)
        SELECT query_id, count(*)::INT AS n, md5(string_agg(line, chr(10) ORDER BY rank)) AS digest FROM l GROUP BY 1""",
    "thinnest_documents": f"""WITH {CHUNKS}, n AS (SELECT document_id, coalesce(sum(length(text)), 0) AS chars FROM c GROUP BY 1)
        SELECT doc_id, rel_path, coalesce(chars, 0) AS chars FROM documents LEFT JOIN n ON document_id = doc_id WHERE lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg') AND coalesce(chars, 0) < 800 AND doc_id % 3 <> 0 ORDER BY chars, doc_id LIMIT 50""",
    "copies_state": "SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'ok' END AS state, count(*) AS documents, min(rel_path) AS least FROM documents GROUP BY 1",
    "eligible_chunks": f"""WITH {CHUNKS} SELECT document_id, count(*) AS chunks FROM c JOIN documents ON doc_id = document_id
        WHERE domain IN ('10_power', '40_fire') AND rel_path IS NOT NULL AND rel_path NOT IN (SELECT rel_path FROM documents WHERE doc_id % 10 = 3 AND rel_path IS NOT NULL) GROUP BY 1""",
    "rerank_permutation": f"""WITH {CANDIDATES}, q AS (SELECT DISTINCT query_id FROM cand),
        rep AS (SELECT query_id, CASE WHEN query_id % 100 = 0 THEN [] ELSE [(query_id // 20 + 3) % 8 + 1, (query_id // 20 + 5) % 8 + 1, 99] END AS said FROM q)
        SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY list_position(said, pos) NULLS LAST, pos) AS rank FROM cand JOIN rep USING (query_id)""",
    "rerank_scores": f"""WITH {CANDIDATES} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 60 = 0 THEN 0 ELSE (query_id // 20 + pos * 3) % 5 END DESC, pos) AS rank FROM cand""",
    "citation_check": f"""WITH {ANSWERS}, g AS (SELECT *, len([x for x in numbers if x BETWEEN 1 AND sources]) AS valid, list_distinct([x for x in numbers if NOT x BETWEEN 1 AND sources]) AS bad FROM n)
        SELECT doc_id, array_to_string(numbers, ',') AS numbers, valid::INT AS valid, (len(numbers) - valid)::INT AS invalid, len(numbers) > 0 AND valid = len(numbers) AS all_valid,
          CASE WHEN len(bad) = 0 THEN answer WHEN len(bad) = 1 THEN replace(answer, '[' || bad[1] || ']', '[invalid citation removed]') ELSE replace(replace(answer, '[' || bad[1] || ']', '[invalid citation removed]'), '[' || bad[2] || ']', '[invalid citation removed]') END AS scrubbed,
          CASE WHEN sources = 0 THEN 'no_relevant' WHEN trim(answer) = '' THEN 'degraded' WHEN valid = 0 THEN 'degraded' WHEN valid < len(numbers) THEN 'partial' ELSE 'grounded' END AS state FROM g""",
    "degraded_excerpts": f"""WITH {CHUNKS}, h AS (SELECT document_id, coalesce(source, '') AS source, text, row_number() OVER (PARTITION BY document_id ORDER BY seq, chunk_id) AS i FROM c JOIN documents ON doc_id = document_id WHERE c.text IS NOT NULL)
        SELECT document_id, string_agg('[' || i || '] ' || source || ' — ' || substr({strip("regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')")}, 1, 320), chr(10) ORDER BY i) AS answer FROM h WHERE i <= 5 GROUP BY 1""".replace("source, text,", "source, c.text AS text,"),
    "prompt_context": f"""WITH {CHUNKS}, h AS (SELECT document_id, coalesce(source, '') AS source, coalesce(domain, '') AS domain, c.text AS text, row_number() OVER (PARTITION BY document_id ORDER BY seq, chunk_id) AS i FROM c JOIN documents ON doc_id = document_id WHERE c.text IS NOT NULL),
        p AS (SELECT document_id, string_agg('<source id="' || i || '" name="' || source || '" domain="' || domain || '">' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY i) AS p FROM h GROUP BY 1)
        SELECT document_id, md5(p) AS digest, length(p) AS n FROM p""",
    "eval_recall_mrr": f"""WITH {CHUNKS}, {bm25(GOLD_QUERIES)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm),
        h AS (SELECT query_id, rank, lower(coalesce(source, '')) AS have FROM r JOIN c USING (chunk_id) JOIN documents ON doc_id = document_id WHERE rank <= 8),
        g AS (SELECT gold_id, min(rank) FILTER (contains(have, lower(expect_source))) AS rank FROM gold LEFT JOIN h ON gold_id = query_id WHERE coalesce(expect_source, '') <> '' GROUP BY 1)
        SELECT count(*) AS questions, round(count(rank) / count(*), 6) AS recall, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM g""",
    "answer_metrics": f"""WITH a AS (SELECT *, length(q) % 4 AS n, coalesce(array_to_string(expected_facts, '; '), '') AS told FROM gold),
        b AS (SELECT *, CASE n WHEN 0 THEN told || ' [1]' WHEN 1 THEN told || ' [3]' WHEN 2 THEN 'I could not find it, the service is offline.' ELSE told END AS answer, CASE n WHEN 2 THEN 0 ELSE 2 END AS sources FROM a),
        c AS (SELECT *, [x::INT for x in regexp_extract_all(answer, '\\[(\\d+)\\]', 1)] AS nums, coalesce(len(expected_facts), 0) > 0 AS has, sources = 0 AND ({' OR '.join(f"contains(lower(answer), {lit(m)})" for m in REFUSALS)}) AS refused FROM b),
        d AS (SELECT *, len([f for f in expected_facts if NOT contains(lower({ascii_('answer')}), lower({ascii_('f')}))]) = 0 AS correct, list_contains(nums, 1) AND len([f for f in expected_facts if NOT contains(lower({ascii_("coalesce(passage, '')")}), lower({ascii_('f')}))]) = 0 AS sup FROM c),
        m AS (SELECT 'citation_presence' AS metric, count(*) FILTER (expect_citations AND len(nums) > 0) AS hits, count(*) FILTER (expect_citations) AS total FROM d
        UNION ALL SELECT 'citation_validity', count(*) FILTER (expect_citations AND len(nums) > 0 AND len([x for x in nums if NOT x BETWEEN 1 AND sources]) = 0), count(*) FILTER (expect_citations) FROM d
        UNION ALL SELECT 'citation_support', count(*) FILTER (has AND sup), count(*) FILTER (has) FROM d
        UNION ALL SELECT 'known_answer_correctness', count(*) FILTER (has AND correct), count(*) FILTER (has) FROM d
        UNION ALL SELECT 'refusal_quality', count(*) FILTER (expected_behaviour = 'refuse' AND refused), count(*) FILTER (expected_behaviour = 'refuse') FROM d
        UNION ALL SELECT 'failure_behaviour', count(*) FILTER (category IN ({listed(FAILURES)}) AND expected_behaviour = 'degraded' AND refused), count(*) FILTER (category IN ({listed(FAILURES)})) FROM d)
        SELECT metric, hits, total, CASE WHEN total > 0 THEN round(hits / total, 6) END AS rate FROM m""",
    "gold_contract": f"""WITH g AS (SELECT *, category IN ({listed([*FAILURES, 'missing_information'])}) AS failing, coalesce(expected_facts, []) AS facts FROM gold)
        SELECT gold_id, ((trim(coalesce(gold_id, '')) = '' OR trim(coalesce(category, '')) = '' OR trim(coalesce(q, '')) = '')::INT + (expect_citations IS NULL)::INT + (failing AND coalesce(expected_behaviour, '') NOT IN ('refuse', 'degraded'))::INT
        + (NOT failing AND (coalesce(expected_behaviour, '') <> 'answer' OR trim(coalesce(expect_source, '')) = '' OR len(facts) = 0))::INT + (NOT failing AND len([f for f in facts if trim(coalesce(f, '')) = '']) > 0)::INT)::INT AS reasons FROM g""",
    "secrets_gate": f"""WITH t AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 97 WHEN 5 THEN chr(10) || 'password = ''hunter2-long''' WHEN 6 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'MIIE' WHEN 7 THEN chr(10) || 'api_key: 0123456789abcdef0123' ELSE '' END AS t FROM documents),
        r AS (SELECT doc_id, array_to_string({SECRET_LIST}, ',') AS reasons FROM t) SELECT doc_id, reasons FROM r WHERE reasons <> ''""",
    "degenerate_summaries": f"""WITH s AS (SELECT doc_id, {strip('summary')} AS s FROM documents WHERE summary IS NOT NULL), w AS (SELECT *, regexp_extract_all(lower(s), '[\\p{{L}}\\p{{N}}_]+') AS w FROM s)
        SELECT doc_id, length(s) < 10 OR (len(w) >= 20 AND len(list_distinct(w)) / len(w) < 0.12) OR len([i for i in range(1, length(s) - 19) if substr(s, i, 21) = repeat(substr(s, i, 1), 21) AND substr(s, i, 1) <> chr(10)]) > 0 AS degenerate FROM w""",
    "extraction_warnings": """WITH t AS (SELECT doc_id, lower(coalesce(text, '') || CASE doc_id % 50 WHEN 1 THEN ' [OCR limited to first 20 pages]' WHEN 2 THEN ' [OCR error on page 3]' WHEN 3 THEN ' [rows truncated]' ELSE '' END) AS t, lower(trim(extractor)) AS e, doc_id % 4 AS p FROM documents)
        SELECT doc_id, array_to_string([x for x in [CASE WHEN contains(t, 'ocr limited to first') THEN 'ocr_page_limit' END, CASE WHEN contains(t, '[ocr error on page') THEN 'ocr_page_error' END, CASE WHEN contains(t, 'rows truncated') THEN 'row_limit' END, CASE WHEN e = 'ocr' AND p = 0 THEN 'ocr_no_pages' END] if x IS NOT NULL], ',') AS warnings FROM t""",
    "thin_documents": f"""WITH {CHUNKS}, n AS (SELECT document_id, coalesce(sum(length(text)), 0) AS chars FROM c GROUP BY 1)
        SELECT doc_id, coalesce(chars, 0) AS chars FROM documents LEFT JOIN n ON document_id = doc_id WHERE lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg') AND coalesce(chars, 0) < 800""",
    "unprocessed_docs": "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM chunks WHERE document_id = doc_id) AND NOT EXISTS (SELECT 1 FROM doc_equipment e WHERE e.document_id = doc_id)",
    "entity_input": f"""WITH {CHUNKS}, h AS (SELECT document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY seq, chunk_id) AS i FROM c WHERE seq < 3 AND text IS NOT NULL),
        t AS (SELECT document_id, string_agg(text, chr(10) ORDER BY i) AS t FROM h WHERE i <= 3 GROUP BY 1), j AS (SELECT doc_id, substr(coalesce(summary, '') || chr(10) || t.t, 1, 2600) AS i FROM documents JOIN t ON document_id = doc_id)
        SELECT doc_id, md5(i) AS digest, length(i) AS n FROM j WHERE length({strip('i')}) >= 40""",
    "classification_sample": """WITH t AS (SELECT doc_id, substr(CASE WHEN length(text) > 1600 THEN substr(text, 1, 800) || chr(10) || '...' || chr(10) || substr(text, length(text) // 2 + 1, 400) || chr(10) || '...' || chr(10) || substr(text, length(text) - 399, 400) ELSE substr(text, 1, 1500) END, 1, 1200) AS t FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5(t) AS digest, length(t) AS n FROM t""",
    "taxonomy_match": f"""WITH r AS (SELECT doc_id, 'it is ' || coalesce(domain, 'unknown') || CASE WHEN doc_id % 4 = 0 THEN ' or 99_MISC' ELSE '' END AS reply FROM documents)
        SELECT doc_id, coalesce([x for x in [{listed(TAXONOMY)}] if contains(reply, x)][1], {lit(TAXONOMY[-1])}) AS domain FROM r""",
    "cooccurrence_pairs": f"WITH {LINKS} SELECT a, b, shared FROM sh",
    "merge_candidates": f"WITH {PROPOSED} SELECT a, b, shared, ratio FROM prop",
    "registry_groups": f"""WITH {KEYS}, h AS (SELECT key, count(DISTINCT document_id) AS docs FROM keys GROUP BY 1),
        al AS (SELECT DISTINCT key, unnest(list_concat(CASE WHEN name IS NULL THEN [] ELSE [name] END, syn)) AS x FROM keys), tg AS (SELECT DISTINCT key, unnest(tags) AS x FROM keys),
        a2 AS (SELECT key, array_to_string(list_sort(list(x))[1:40], '|') AS aliases FROM al WHERE x <> '' AND length(x) < 60 GROUP BY 1), t2 AS (SELECT key, array_to_string(list_sort(list(x))[1:40], '|') AS tags FROM tg WHERE x <> '' GROUP BY 1)
        SELECT key AS equipment_key, docs, coalesce(aliases, '') AS aliases, coalesce(tags, '') AS tags FROM h LEFT JOIN a2 USING (key) LEFT JOIN t2 USING (key)""",
    "registry_summary": f"WITH {KEYS}, n AS (SELECT key, count(DISTINCT document_id) AS n FROM keys GROUP BY 1) SELECT count(*) AS equipment, coalesce(sum(n), 0) AS links, count(*) FILTER (n > 1) AS multi_doc FROM n",
    "apply_merges": f"""WITH RECURSIVE {PROPOSED}, conf AS (SELECT a, b FROM prop WHERE (a + b) % 3 <> 0),{components('conf')},
        fa AS (SELECT id, component, eq.bare, coalesce(n, 0) AS n FROM comp JOIN eq ON equipment_id = id LEFT JOIN ln ON ln.e = id),
        rk AS (SELECT *, first_value(id) OVER w AS kept, row_number() OVER w AS place FROM fa WINDOW w AS (PARTITION BY component ORDER BY bare, n DESC, id)),
        mv AS (SELECT id AS dropped, kept FROM rk WHERE place > 1), rl AS (SELECT DISTINCT coalesce(kept, e) AS e, d FROM l LEFT JOIN mv ON dropped = e), n2 AS (SELECT e, count(*) AS documents FROM rl GROUP BY 1)
        SELECT dropped, kept, documents FROM mv JOIN n2 ON n2.e = kept""",
    "json_payload": "SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN 'M' || (doc_id % 5) END AS make, CASE WHEN doc_id % 4 < 3 THEN 'T' || doc_id END AS tag FROM documents",
    "latest_state": "SELECT pending_id, arg_max(state, (updated_at, state)) AS state, arg_max(batch_id, (updated_at, state)) AS batch_id FROM (SELECT DISTINCT pending_id, state, updated_at, batch_id FROM ingest_pending) GROUP BY 1",
    "dead_letters": "SELECT pending_id FROM (SELECT pending_id, arg_max(state, (updated_at, state)) AS state FROM ingest_pending GROUP BY 1) WHERE state = 'dead_letter'",
    "attempt_fold": f"""WITH a AS (SELECT user_id AS src, ts, event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} ELSE 'error' END AS action FROM events),
        r AS (SELECT *, max(CASE WHEN action = 'retry_requested' THEN (ts, event_id) END) OVER (PARTITION BY src) AS reset FROM a),
        n AS (SELECT src, count(*) FILTER ((reset IS NULL OR (ts, event_id) > reset) AND action NOT IN ({listed(TERMINAL)}) AND action <> 'retry_requested') AS attempts, count(*) FILTER ((reset IS NULL OR (ts, event_id) > reset) AND action IN ({listed(TERMINAL)})) AS ended FROM r GROUP BY 1)
        SELECT src, attempts, ended > 0 OR attempts >= 3 AS done FROM n""",
    "consistency_audit": f"""WITH {CHUNKS}, a AS (SELECT document_id, count(*) AS n FROM c GROUP BY 1), dead AS (SELECT DISTINCT pending_id FROM ingest_pending WHERE state = 'dead_letter'),
        x AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(DISTINCT chunk_id) FROM vchunks) AS vectors,
          (SELECT count(*) FROM documents LEFT JOIN a ON document_id = doc_id WHERE coalesce(n, 0) <> coalesce(n_chunks, -1)) AS chunk_mismatches,
          (SELECT count(DISTINCT pending_id) FROM ingest_pending WHERE pending_id NOT IN (SELECT pending_id FROM dead)) AS pending, (SELECT count(*) FROM dead) AS dead_letters)
        SELECT *, chunks <> vectors AS index_drift, chunks = vectors AND chunk_mismatches = 0 AND pending = 0 AS ok FROM x""",
    "stale_documents": f"SELECT doc_id, rel_path FROM documents WHERE ingested_at <= TIMESTAMP '{NOW}' - INTERVAL {STALE_DAYS} DAY",
    "reconcile_actions": f"WITH {FACTS} SELECT pending_id, CASE WHEN document AND curated THEN 'reconciled' WHEN curated THEN 'curated' WHEN source THEN 'staged' ELSE 'dead_letter' END AS decision, NOT (document AND curated) AND (curated OR source) AS retry FROM f",
    "ingest_actions": f"""WITH {FACTS}, t0 AS (SELECT pending_id, max(text) AS t FROM staged_text GROUP BY 1), j AS (SELECT f.*, t, {strip("coalesce(t, '')")} AS s, lower(regexp_extract(rel_path, '\\.([^./]*)$', 1)) AS ext, regexp_extract(rel_path, '([^/]*)$', 1) AS base FROM f LEFT JOIN t0 USING (pending_id))
        SELECT pending_id, CASE WHEN pending_id % 101 = 0 THEN 'skip_unsafe' WHEN ext NOT IN ({listed(EXTENSIONS)}) OR starts_with(base, '~$') OR starts_with(base, '.') THEN 'skip_nondoc' WHEN regexp_matches(rel_path, {lit(SECRET_NAMES)}) THEN 'quarantine_secret' WHEN document THEN 'skip_duplicate'
          WHEN length(s) < 20 THEN 'skip_empty' WHEN len({SECRET_LIST}) > 0 THEN 'quarantine_secret' ELSE 'processed' END AS action FROM j""",
    "snapshot_upsert": """WITH o AS (SELECT pending_id, arg_max(state, (updated_at, state)) AS state, max(updated_at) AS u, 0 AS c FROM ingest_pending WHERE state IN ('staged', 'curated') GROUP BY 1),
        n AS (SELECT pending_id, arg_max(state, (updated_at, state)) AS state, max(updated_at) AS u, 1 AS c FROM ingest_pending WHERE state IN ('indexed', 'dead_letter') GROUP BY 1)
        SELECT pending_id, arg_max(state, (u, c)) AS state FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1""",
    "promoted_names": r"""WITH p AS (SELECT lpad(pending_id::VARCHAR, 12, '0') AS rel_path, max(sha256) AS sha256, max(dest_rel_path) AS dst FROM ingest_pending WHERE sha256 IS NOT NULL GROUP BY pending_id),
        f AS (SELECT rel_path, sha256, regexp_extract(dst, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(dst, '([^/]*)$', 1) AS base FROM p),
        n AS (SELECT *, row_number() OVER w AS n, first_value(sha256) OVER w AS fs, row_number() OVER (PARTITION BY dir, base, sha256 ORDER BY rel_path) AS m, regexp_extract(base, '^(.+?)(\.[^.]*)?$', 1) AS root, regexp_extract(base, '^(.+?)(\.[^.]*)?$', 2) AS ext FROM f WINDOW w AS (PARTITION BY dir, base ORDER BY rel_path))
        SELECT rel_path, dir || '/' || CASE WHEN n = 1 THEN base WHEN m = 1 AND sha256 <> fs THEN root || '__' || substr(sha256, 1, 8) || ext ELSE root || '__' || substr(sha256, 1, 8) || '_' || n || ext END AS dest FROM n""",
    "register_rows": """WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, i - 1 AS row_no, [trim(regexp_replace(x, '[\\s\\x0B]+', ' ', 'g')) for x in string_split(ls[i], chr(9))] AS cells FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
        h AS (SELECT doc_id, min(row_no) AS h, arg_min(cells, row_no) AS head FROM r WHERE len([x for x in cells if x <> '']) >= 3 AND len([x for x in cells if contains(lower(x), 'serial')]) > 0 GROUP BY 1),
        w AS (SELECT doc_id, h, list_max([CASE WHEN head[i] <> '' THEN i ELSE 0 END for i in range(1, len(head) + 1)]) AS w FROM h)
        SELECT doc_id, row_no::INT AS row_no, array_to_string([coalesce(cells[i], '') for i in range(1, w + 1)], chr(9)) AS line FROM r JOIN w USING (doc_id) WHERE row_no = h OR (row_no > h AND len([x for x in cells if x <> '']) > 0)""",
    "inbox_candidates": f"""SELECT DISTINCT src_path AS rel_path FROM ingest_pending WHERE lower(regexp_extract(src_path, '\\.([^./]*)$', 1)) IN ({listed(EXTENSIONS)}) AND NOT starts_with(regexp_extract(src_path, '([^/]*)$', 1), '~$') AND NOT regexp_matches(src_path, '(^|/)\\.')
        AND src_path NOT IN (SELECT src_path FROM ingest_pending WHERE state = 'indexed' AND src_path IS NOT NULL)""",
    "gain_gate": f"""WITH {CHUNKS}, n AS (SELECT document_id, coalesce(sum(length(text)), 0) AS o FROM c GROUP BY 1)
        SELECT document_id, CASE WHEN document_id % 13 = 0 THEN 'describe_error' WHEN NOT o + document_id % 5 * 100 > o + 200 THEN 'no_gain' WHEN document_id % 7 = 0 THEN 'swap_error' ELSE 'described' END AS action FROM n""",
    "dpi_cap": """WITH p AS (SELECT p_partkey, p_size * 1.5::DOUBLE * 300 * (p_size * 0.9::DOUBLE) * 300 AS px FROM part)
        SELECT p_partkey, CASE WHEN px > 20000000 THEN greatest(50, floor(300 * sqrt(20000000 / px) * 0.95)::INT) ELSE 300 END AS dpi FROM p""",
    "content_signature": """WITH h AS (SELECT sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(rel_path, chr(1)), coalesce(sha256, chr(1)), coalesce(text, chr(1)))) AS h FROM documents)
        SELECT count(*) AS rows, sha256(concat_ws(',', sum(('0x' || substr(h, 1, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 37, 12))::BIGINT)::VARCHAR)) AS signature FROM h""",
    "fold_unicode": f"SELECT doc_id, md5({ascii_('text')}) AS digest FROM documents WHERE text IS NOT NULL",
}
