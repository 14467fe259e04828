"""SQL, written for DuckDB, that checks the queries of this subpackage which SQL can express."""

from __future__ import annotations

import unicodedata

#: White space and line breaks as the engine's own rules have them.
_SPACE = "[\\s\\p{Z}\\x{FEFF}\\x{200B}]"
_BREAKS = "[\\n\\r\\x0B\\x0C\\x{85}\\x{2028}\\x{2029}\\t|;]+"


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters that NFKC replaces by one other, those others, and those it replaces by several of which one is a letter or digit.

    Told from Unicode's tables for the blocks below U+3400 and the compatibility forms; what only parts words is left as it is.
    """
    one, other, many = "", "", []
    for code in [*range(0xA0, 0x3400), *range(0xF900, 0x10000)]:
        c = chr(code)
        n = unicodedata.normalize("NFKC", c)
        if n == c or unicodedata.normalize("NFC", c) == n or not (c + n).isprintable():
            continue
        if len(n) == 1:
            one, other = one + c, other + n
        elif any(x.isalnum() for x in n) and (code < 0x2500 or 0xFB00 <= code < 0xFB07):
            many.append((c, n))
    return one, other, many


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc(x: str) -> str:
    one, other, many = _compatible()
    for c, n in many:
        x = f"replace({x}, {_lit(c)}, {_lit(n)})"
    return f"nfc_normalize(translate({x}, {_lit(one)}, {_lit(other)}))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+')"


#: CTEs that end in k(id, w, f): the words of each chunk, and the sorted fields of a register record.
CHUNKS = f"""
raw AS (SELECT DISTINCT chunk_id AS id, {nfkc("text")} AS t, text FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL),
piece AS (SELECT id, t, text, [p for p in string_split_regex(text, '{_BREAKS}') if regexp_matches(p, '[^\\s\\p{{Z}}\\x{{FEFF}}\\x{{200B}}]')] AS ps FROM raw),
k AS (SELECT id, {words("t")} AS w, CASE WHEN len(ps) >= 3 AND len([p for p in ps if NOT regexp_matches(p, '^[^:=]*[\\p{{L}}\\p{{N}}][^:=]*[:=]')]) = 0 THEN
  list_sort([array_to_string({words(nfkc("regexp_extract(p, '^([^:=]*)[:=]', 1)"))}, ' ') || chr(2) || array_to_string({words(nfkc("regexp_extract(p, '(?s)^[^:=]*[:=](.*)$', 1)"))}, ' ') for p in ps]) END AS f FROM piece)"""
#: CTEs that end in g(id, gid): copies by words or by fields, told over both kinds of groups until nothing is joined any more.
COPIES = CHUNKS + """,
k1 AS (SELECT id, w, coalesce(f, w) AS key, f IS NULL AS plain FROM k WHERE len(w) > 0),
g1 AS (SELECT *, min(id) OVER (PARTITION BY plain, key) AS m FROM k1),
g2 AS (SELECT *, min(m) OVER (PARTITION BY w) AS m2 FROM g1),
g3 AS (SELECT *, min(m2) OVER (PARTITION BY plain, key) AS m3 FROM g2),
g4 AS (SELECT *, min(m3) OVER (PARTITION BY w) AS m4 FROM g3),
g AS (SELECT DISTINCT id, min(m4) OVER (PARTITION BY plain, key) AS gid FROM g4)"""


def shingled(source: str) -> str:
    """(id, s) of a table or CTE of (id, w): each different run of three words, of texts of 30 words or more."""
    return f"SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM {source} WHERE len(w) >= 30)"


P2_FOUND = f"WITH {COPIES} SELECT gid AS chunk_id_a, id AS chunk_id_b FROM g WHERE id <> gid"
P2_COUNTS = f"WITH {COPIES} SELECT gid AS chunk_id, count(*) AS copies FROM g GROUP BY 1"
P7_FOUND = f"""WITH {CHUNKS}, s AS ({shingled("k")}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS ab FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
near AS (SELECT a, b FROM b JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE ab >= (p.n + q.n - ab) * 0.7 - 1e-9)
SELECT DISTINCT a AS chunk_id_a, b AS chunk_id_b FROM near JOIN k x ON x.id = a JOIN k y ON y.id = b WHERE x.w <> y.w AND (x.f IS NULL OR y.f IS NULL OR x.f <> y.f)"""
P9_FOUND = f"""WITH d AS (SELECT doc_id AS id, {words(nfkc("text"))} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT gold_id AS id, {words(nfkc("t"))} AS w FROM (SELECT gold_id, unnest([q, passage]) AS t FROM gold) WHERE t IS NOT NULL AND gold_id IS NOT NULL),
r AS (SELECT DISTINCT id, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM i WHERE len(w) >= 12)),
x AS (SELECT DISTINCT id, array_to_string(w[p:p + 11], ' ') AS run FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS p FROM d WHERE len(w) >= 12))
SELECT DISTINCT x.id AS doc_id, r.id AS gold_id FROM x JOIN r USING (run)"""
P6_FOUND = """WITH v AS (SELECT DISTINCT chunk_id AS id, embedding::DOUBLE[] AS e FROM vchunks WHERE len(embedding) = 64 AND chunk_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT x.id AS chunk_id_a, y.id AS chunk_id_b FROM v x JOIN v y ON x.id < y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.9"""


def _digest(x: str) -> str:
    h = f"regexp_replace(regexp_replace(lower({x}), '^\\W*sha-?_?256\\W*', ''), '[\\s:_-]', '', 'g')"
    return f"CASE WHEN regexp_matches({h}, '^[0-9a-f]{{64}}$') THEN {h} END"


P1_FOUND = f"""WITH fl AS (SELECT pending_id AS p, coalesce(min(batch_id), -1048576) AS b, max({_digest("sha256")}) AS sha FROM ingest_pending WHERE pending_id IS NOT NULL GROUP BY 1),
seen AS (SELECT sha, min((b, p)) AS first FROM fl WHERE sha IS NOT NULL GROUP BY 1),
exact AS (SELECT p FROM fl JOIN seen USING (sha) WHERE (b, p) <> first OR sha IN (SELECT {_digest("sha256")} FROM documents WHERE {_digest("sha256")} IS NOT NULL)),
tx AS (SELECT 2 * doc_id AS id, -2000000::BIGINT AS b, doc_id AS p, {words(nfkc("text"))} AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 2 * p + 1, b, p, {words(nfkc("text"))} FROM (SELECT DISTINCT ON (pending_id) pending_id, text FROM staged_text WHERE text IS NOT NULL) JOIN fl ON p = pending_id),
s AS ({shingled("tx")}), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT x.id AS i, y.id AS j, count(*) AS ab FROM s x JOIN s y ON x.s = y.s WHERE x.id % 2 = 1 AND x.id <> y.id GROUP BY ALL),
near AS (SELECT DISTINCT x.p FROM c JOIN n p ON p.id = i JOIN n q ON q.id = j JOIN tx x ON x.id = i JOIN tx y ON y.id = j WHERE ab >= (p.n + q.n - ab) * 0.8 - 1e-9 AND (y.b, y.p) < (x.b, x.p))
SELECT p AS pending_id, 'exact' AS kind FROM exact UNION ALL SELECT p, 'near' FROM near WHERE p NOT IN (SELECT p FROM exact)"""
