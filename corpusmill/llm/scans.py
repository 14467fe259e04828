"""Problem 3: noise in text from scanned pages.

The vocabulary is counted over all chunks of documents that weren't scanned. Scanned chunks are read line by line: lines
that only name the document along with its site, revision or sheet, and lines with only a page number, are page furniture;
words cut at a line end are joined over it. Tokens of the running text that the vocabulary lacks are looked up by
intersecting a Levenshtein automaton with the trie of the vocabulary, which finds every word within the distance; those
that customary misreadings explain are ranked by the number of misreadings, by their neighbours in the text and by
frequency. Then the furniture is taken out and the lines are put together to paragraphs.

Defined results: null ids, null and empty texts and chunks of documents that weren't scanned give nothing; a row delivered twice
counts once; ``[Page N]`` markers and headings stay; ties are broken by the alphabet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut, small

#: A word of the vocabulary stands this often in texts that weren't scanned.
COMMON = 3
#: Words of one shard of the vocabulary's trie.
TRIE_WORDS = 200_000
#: Unknown tokens looked up by one task; more, where the vocabulary is larger and takes longer to be put into a trie.
BLOCK_TOKENS = 250
#: Parts of the blocks that a trie goes to where the tries are too large to be sent everywhere.
SALTS = 16
HYPHENS = "-‐‑¬\xad"
BREAKS = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]+")

#: Customary misreadings, what is read and what stood there.
MISREAD = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("@", "a"), ("(", "c"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("u", "n"), ("n", "u"), ("v", "y"), ("o", "c"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("m", "nn"), ("nn", "m"), ("ri", "n"), ("li", "h"), ("2", "z"),
]
#: Letters read for digits.
DIGITS = {"O": "0", "o": "0", "D": "0", "l": "1", "I": "1", "i": "1", "!": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "G": "6", "B": "8", "g": "9", "q": "9"}
NUMBER = re.compile(r"(?=.*\d)(?=.*[A-Za-z!|])[0-9OoDlIi!|ZzSsbGBgq]+(?:[.,][0-9OoDlIi!|ZzSsbGBgq]+)?")
CODE = re.compile(r"[A-Za-z]{1,4}-\w*\d\w*(?:-\w+)*|.*(?:[/\\=:<>_#&]|\d-\d).*")

_PAGE_WORD = "(?:page|pg|p|sheet|seite|blatt|s|page|feuille|folio|página|pág|pag|hoja)"
PAGE = re.compile(rf"[\W_]*(?:{_PAGE_WORD}\.?\s*)?[0-9OolI]{{0,3}}[0-9][0-9OolI]{{0,3}}(?:\s*(?:/|of|von|de|sur|aus)\s*[0-9OolI]{{1,4}})?[\W_]*", re.I)
MARKER = re.compile(r"\s*\[Page \d+\]", re.I)
HEADING = re.compile(r"\s*(?:\[Page \d+\]\s*)?(?:#{1,6}\s|\d+(?:\.\d+)*\.?\s+\S)", re.I)
TAG = r"[A-Za-z0-9@!(|]{1,5}-[0-9A-Za-z!|]{1,5}"

_SKELETON = str.maketrans({"0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "8": "h", "6": "h", "b": "h", "9": "g", "q": "g", "@": "a", "(": "c", "e": "c", "o": "c", "f": "t"})


def skeleton(text: str) -> str:
    """A form that misreadings leave as it is."""
    s = re.sub(r"\s+", " ", text.lower()).strip()
    for a, b in (("rn", "m"), ("nn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u")):
        s = s.replace(a, b)
    return s.replace("0", "o").translate(_SKELETON)


def is_page(line: str) -> bool:
    """Only a page number."""
    s = line.strip()
    return bool(s) and len(s) <= 24 and not MARKER.match(s) and bool(PAGE.fullmatch(s) or PAGE.fullmatch(_page_word(s)))


def _page_word(s: str) -> str:
    """The line with a misread page word set right."""
    m = re.match(r"(\W*)([^\W\d]\S{0,5}?|[^\s\d]{2,6})(\.?\s+\d.*)", s)
    if m:
        for w in ("page", "sheet", "seite", "blatt", "hoja", "pg", "folio"):
            if skeleton(m[2]) == skeleton(w):
                return m[1] + w + m[3]
    return s


_SUFFIX = re.compile(r"(?:\s*[–—·|/\-•]\s*\S.{0,60}|\s{2,}\S.{0,20}|\s+\d{1,3}\s*/\s*\d{1,3})?\s*")


def named(line: str) -> list[str]:
    """Skeletons of what would have to be a title for the line only to name document, site, revision or sheet: a tag and a
    title, something before or behind, no sentence."""
    s, out = line.strip(), []
    if not 8 <= len(s) <= 130 or HEADING.match(s) or MARKER.match(s):
        return out
    for m in re.finditer(rf"(?:(?<=\s)|^){TAG}\s+", s):
        before, rest = s[: m.start()], s[m.end() :]
        if len(before.split()) > 5 or re.search(r"[.,;:()\d]\s", before + " "):
            continue
        for n, w in enumerate(re.finditer(r"\S+", rest)):
            if n == 7:
                break
            behind = rest[w.end() :]
            if (before.strip() or behind.strip()) and _SUFFIX.fullmatch(behind) and not behind.rstrip().endswith((".", ",", ";")):
                out.append(skeleton(rest[: w.end()]))
    return out


def is_header(line: str, titles: set[str]) -> bool:
    """Only the names of document, site, revision or sheet."""
    return bool(titles) and any(t in titles for t in named(line))


_STRIP = ".,;:)]}\"'”’»?…>*"
_LEAD = "([{\"'“‘«<*•–—"


def tokens(line: str) -> list[str]:
    return [t for w in line.replace("\u200b", "").replace("\ufeff", "").split() if (t := w.lstrip(_LEAD).rstrip(_STRIP))]


def key_of(token: str) -> str:
    """As the vocabulary counts it: lower case, digits as 0."""
    return re.sub(r"\d", "0", token.lower())


_LEFT = re.compile(rf"([^\W\d_]+(?:['’-][^\W\d_]+)*)([{HYPHENS}])\s*$")
_RIGHT = re.compile(r"\s*([^\W\d_]+(?:['’-][^\W\d_]+)*)")


def read(text: str, titles: set[str]) -> list[tuple[str, str, str, str]]:
    """(kind, item, a, b) of everything of note: header and page lines, split words (item as joined; a, b the halves), tokens
    of the running text (a, b the tokens before and behind)."""
    out, lines = [], []
    for line in BREAKS.split(text):
        if is_page(line):
            out.append(("page", line.strip(), "", ""))
        elif is_header(line, titles):
            out.append(("header", line.strip(), "", ""))
        elif line.strip():
            lines.append(line)
    flow: list[str] = []
    for i, line in enumerate(lines):
        ts = tokens(MARKER.sub("", line))
        if ts and i and (cut_at := _split(lines[i - 1], line)):
            left, right = cut_at
            out.append(("split", (left + right).lower(), left.lower(), right.lower()))
            flow, ts = flow[:-1], [left + right, *ts[1:]]
        flow += ts
    low = [t if NUMBER.fullmatch(t) else t.lower() for t in flow]
    for k, t in enumerate(low):
        if len(t) > 1 and len(t) < 40 and not t.isdigit() and not CODE.fullmatch(t) and re.search(r"[^\W\d_]", t):
            out.append(("token", t, low[k - 1] if k else "", low[k + 1] if k + 1 < len(low) else ""))
    return out


def _split(line: str, after: str) -> tuple[str, str] | None:
    m = _LEFT.search(line)
    n = _RIGHT.match(after) if m else None
    if not n or MARKER.match(after) or HEADING.match(after):
        return None
    left, right = m[1], n[1]
    if right[0].isupper() and not left[-1].isupper():
        return None
    return left, right


class Trie:
    """Words in nested dicts; the key "" holds the word."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def within(self, token: str, distance: int) -> list[tuple[str, int]]:
        """All words within the distance. The automaton's states after each number of errors are the bits of one integer:
        bit i says that i letters of the token can have been read."""
        masks: dict[str, int] = {}
        for i, c in enumerate(token):
            masks[c] = masks.get(c, 0) | 1 << i
        end, full = 1 << len(token), (2 << len(token)) - 1
        start, r = [], 1
        for _ in range(distance + 1):
            start.append(r)
            r = (r | r << 1) & full
        found, todo = [], [(self.root, start)]
        while todo:
            node, states = todo.pop()
            for c, child in node.items():
                if c == "":
                    for e, r in enumerate(states):
                        if r & end:
                            found.append((child, e))
                            break
                    continue
                m = masks.get(c, 0)
                new = [(states[0] & m) << 1]
                for e in range(1, distance + 1):
                    before = states[e - 1]
                    new.append(((states[e] & m) << 1 | before | before << 1 | new[e - 1] << 1) & full)
                if new[-1]:
                    todo.append((child, new))
        return found


def misreadings(token: str, word: str) -> int | None:
    """The least number of customary misreadings that turn the word into the token; None if there is no such way."""
    inf = 99
    best = [[inf] * (len(word) + 1) for _ in range(len(token) + 1)]
    best[0][0] = 0
    for i in range(len(token) + 1):
        for j in range(len(word) + 1):
            now = best[i][j]
            if now == inf:
                continue
            if i < len(token) and j < len(word) and token[i] == word[j]:
                best[i + 1][j + 1] = min(best[i + 1][j + 1], now)
            for a, b in MISREAD:
                if token.startswith(a, i) and word.startswith(b, j):
                    x, y = i + len(a), j + len(b)
                    best[x][y] = min(best[x][y], now + 1)
    return best[-1][-1] if best[-1][-1] < inf else None


def number(token: str) -> str | None:
    """The number that was misread."""
    return "".join(DIGITS.get(c, c) for c in token) if NUMBER.fullmatch(token) else None


_ACCENTS = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")


def candidates(token: str, trie: Trie) -> list[tuple[str, int]]:
    """(word, misreadings) of the words that the token may stand for."""
    out = []
    for w, _ in trie.within(token, 1 if len(token) < 4 else 2):
        n = misreadings(token, w)
        if n is None and token.translate(_ACCENTS) != token:  # é for è and the like aren't told apart, misread letters are
            n = misreadings(token.translate(_ACCENTS), w.translate(_ACCENTS))
        if n and n <= 2:
            out.append((w, n))
    return out


TOKEN = "[\\p{L}\\p{N}]+(?:[-'’.][\\p{L}\\p{N}]+)*"


def _key(text: Column) -> Column:
    return F.translate(F.lower(text), "123456789", "000000000")


def scanned(documents: DataFrame) -> DataFrame:
    """doc_id of the scanned documents: extractor ocr in any spelling, or null."""
    e = F.lower(F.regexp_replace(F.col("extractor"), "^[\\s\\p{Z}]+|[\\s\\p{Z}]+$", ""))
    return documents.where(F.col("extractor").isNull() | (e == "ocr")).select(F.col("doc_id").cast("long").alias("document_id")).distinct()


def titles_of(chunks: DataFrame) -> DataFrame:
    """title: skeletons of the titles that stand behind a tag in any document's headings, in any line."""
    title = F.regexp_extract("line", f"^(?:\\[Page \\d+\\]\\s*)?#+\\s+[A-Z]{{1,5}}-\\d+\\s+(\\S.{{2,60}}?)\\s*$", 1)
    lines = chunks.where(F.col("text").contains("#")).select(F.explode(F.filter(F.split("text", BREAKS.pattern), lambda x: x.contains("#"))).alias("line"))
    told = lines.select(F.lower(title).alias("title")).where("title <> ''").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([skeleton(t) for t in b.column(0).to_pylist()], pa.string())], names=["title"])

    return told.mapInArrow(work, "title string").distinct()


def with_titles(chunks: DataFrame, scans: DataFrame) -> DataFrame:
    """(chunk_id, text, titles): the scanned chunks, each with those of all titles that its own lines may name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = {(c, t) for c, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for line in BREAKS.split(text) for t in named(line)}
            cols = list(zip(*pairs)) or [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["chunk_id", "title"])

    held = scans.select("chunk_id", "text")
    known = held.mapInArrow(work, "chunk_id long, title string").join(small(cut(titles_of(chunks))), "title")
    return held.join(small(cut(known.groupBy("chunk_id").agg(F.collect_set("title").alias("titles")))), "chunk_id", "left")


def vocabulary(clean: DataFrame) -> DataFrame:
    """(key, n): tokens of the texts that weren't scanned, in lower case and with 0 for every digit."""
    words = F.explode(F.regexp_extract_all(_key(F.col("text")), F.lit(TOKEN), F.lit(0)))
    return clean.where("text is not null").select(words.alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)


def _read_all(chunks: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                b = whole.slice(s, 500)
                ids, rows = [], []
                for c, t, titles in zip(*(x.to_pylist() for x in b.columns)):
                    found = read(t, set(titles or []))
                    ids += [c] * len(found)
                    rows += found
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.string()) for c in cols]], names=["chunk_id", "kind", "item", "a", "b"])

    return chunks.select("chunk_id", "text", "titles").mapInArrow(work, "chunk_id long, kind string, item string, a string, b string")


@lru_cache(maxsize=4)
def _trie(words: tuple[str, ...]) -> Trie:
    return Trie(words)


def corrections(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(token, word, misreadings, n): every word of the vocabulary that an unknown token may stand for.

    The vocabulary is dealt into tries of at most about TRIE_WORDS words, the tokens into blocks; every block meets every trie.
    """
    size = words.count()
    n, tasks = max(1, -(-size // TRIE_WORDS)), max(1, -(-unknown.count() // max(BLOCK_TOKENS, size // 100)))
    letters = words.where(F.length("key") > 1).withColumn("trie", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"))
    tries = cut(letters.groupBy("trie").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("words")))
    blocks = unknown.groupBy(F.pmod(F.xxhash64("token"), F.lit(tasks)).cast("int").alias("block")).agg(F.collect_list("token").alias("tokens"))
    # by size alone AQE would put all blocks, small but long in work, into one task
    dealt = blocks.withColumn("trie", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(min(20_000, n * tasks), "block", "trie")
    hinted = small(tries)
    if hinted is not tries:
        met = dealt.join(hinted, "trie")
    else:  # too large to be sent everywhere: each trie goes to SALTS places
        met = dealt.withColumn("salt", F.pmod("block", F.lit(SALTS))).join(tries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["trie", "salt"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                held = b.column(1)[k].values
                keys = tuple(held.field("key").to_pylist())
                counts = dict(zip(keys, held.field("n").to_pylist()))
                rows = [(t, w, m, counts[w]) for t in b.column(0)[k].as_py() for w, m in candidates(t, _trie(keys))]
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["token", "word", "misreadings", "n"])

    return met.select("tokens", "words").mapInArrow(work, "token string, word string, misreadings int, n long")


def noise(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, kind, item, raw): all noise of the scanned chunks; raw is what stands in the text (for split, the halves)."""
    ids = small(cut(scanned(documents)))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), "text").where("text is not null and chunk_id is not null")
    words = cut(vocabulary(rows.join(ids, "document_id", "left_anti")))
    seen = cut(_read_all(with_titles(rows, rows.join(ids, "document_id", "left_semi"))))
    furniture = seen.where("kind in ('header', 'page')").select("chunk_id", "kind", "item", F.col("item").alias("raw"))

    told = seen.where("kind = 'token'").select("chunk_id", F.col("item").alias("token"), "a", "b")
    kinds = told.groupBy("token").agg(F.count("*").alias("seen")).withColumn("key", _key(F.col("token")))
    known = small(words)
    unknown = cut(kinds.join(known.select("key"), "key", "left_anti").select("token"))

    numbers_only = F.col("token").rlike(f"^(?=.*\\d)(?=.*[A-Za-z!|])[0-9{''.join(DIGITS)}]+([.,][0-9{''.join(DIGITS)}]+)?$")
    digits = unknown.where(numbers_only).select("token", F.translate("token", "".join(DIGITS), "".join(DIGITS.values())).alias("word"))
    letters = words.where(F.col("key").rlike("^[\\p{L}'’.-]+$"))
    spelt = cut(corrections(unknown.where(~numbers_only & F.col("token").rlike("\\p{L}.*\\p{L}")), letters))
    least = Window.partitionBy("token")
    spelt = spelt.withColumn("best", F.min("misreadings").over(least)).where("misreadings = best").withColumn("many", F.count("*").over(least))

    sure = spelt.where("many = 1").select("token", "word").union(digits)
    plain = told.join(small(sure), "token").select("chunk_id", "token", "word")
    # several words explain the token equally well: its neighbours decide, then frequency
    open_ = told.join(small(spelt.where("many > 1").select("token", "word", "n")), "token")
    pairs = told.groupBy("a", F.col("token").alias("w")).agg(F.count("*").alias("c"))
    before = open_.join(pairs.select("a", F.col("w").alias("word"), F.col("c").alias("before")), ["a", "word"], "left")
    after = before.join(pairs.select(F.col("a").alias("word"), F.col("w").alias("b"), F.col("c").alias("after")), ["word", "b"], "left")
    order = Window.partitionBy("chunk_id", "token", "a", "b").orderBy(F.desc(F.coalesce("before", F.lit(0)) + F.coalesce("after", F.lit(0))), F.desc("n"), "word")
    chosen = after.withColumn("place", F.row_number().over(order)).where("place = 1").select("chunk_id", "token", "word")
    misread = plain.union(chosen)

    halves = seen.where("kind = 'split'").select("chunk_id", F.col("item").alias("joined"), F.concat_ws("-", "a", "b").alias("hyphened"), "a", "b")
    counted = halves.join(known.select(F.col("key").alias("joined"), F.col("n").alias("nj")), "joined", "left").join(known.select(F.col("key").alias("hyphened"), F.col("n").alias("nh")), "hyphened", "left")
    whole = F.when(F.coalesce("nh", F.lit(0)) > F.coalesce("nj", F.lit(0)), F.col("hyphened")).otherwise(F.col("joined"))
    # a split word may be misread too
    fixed = misread.select("chunk_id", F.col("token").alias("joined"), "word").distinct()
    split = counted.join(fixed, ["chunk_id", "joined"], "left").select("chunk_id", F.lit("split").alias("kind"), F.when(F.col("nj").isNull() & F.col("nh").isNull(), F.coalesce("word", whole)).otherwise(whole).alias("item"), F.concat_ws("-", "a", "b").alias("raw"))
    joined = halves.select("chunk_id", F.col("joined").alias("token")).distinct()
    alone = misread.join(joined, ["chunk_id", "token"], "left_anti")
    return furniture.union(split).union(alone.select("chunk_id", F.lit("misread").alias("kind"), F.col("word").alias("item"), F.col("token").alias("raw"))).distinct()


def found(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, kind, item): split, misread, header or page."""
    return noise(chunks, documents).select("chunk_id", "kind", "item").distinct()


def mend(text: str, titles: set[str], right: dict[str, str], whole: dict[str, str]) -> str:
    """Paragraphs without furniture, with split words joined and misread ones set right. Headings, list items, table rows and
    fields keep lines of their own."""
    paragraphs: list[str] = []
    fresh = True
    for line in re.split("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", text):
        s = line.strip()
        if not s:
            fresh = True
            continue
        if is_page(line) or is_header(line, titles):
            continue
        own = bool(HEADING.match(s)) or s[0] in "-*•–|" or bool(re.match(r"[\w ]{2,30}\s*[:=]\s", s)) or "\t" in s
        if paragraphs and not own and not fresh and not paragraphs[-1].endswith("\n"):
            cut_at = _split(paragraphs[-1], s)
            if cut_at:
                left, rest = paragraphs[-1].rstrip(), s[len(cut_at[1]) :]
                word = whole.get(f"{cut_at[0]}-{cut_at[1]}".lower(), cut_at[0] + cut_at[1])
                if word.replace("-", "") == (cut_at[0] + cut_at[1]).replace("-", "").lower():  # keep the case of the text
                    word = cut_at[0] + ("-" if len(word) > len(cut_at[0] + cut_at[1]) else "") + cut_at[1]
                paragraphs[-1] = left[: -len(cut_at[0]) - 1] + word + rest
            else:
                paragraphs[-1] += " " + s
        else:
            paragraphs.append(s)
        fresh = False
        if own:
            paragraphs[-1] += "\n"

    def word_at(m: re.Match) -> str:
        w = m[0]
        core = w.lstrip(_LEAD).rstrip(_STRIP)
        new = right.get(core) or right.get(core.lower())
        if not core or not new:
            return w
        new = new.upper() if core.isupper() and len(core) > 1 and not core[0].isdigit() else new.capitalize() if core[0].isupper() else new
        return w.replace(core, new, 1)

    return "\n".join(re.sub(r"\S+", word_at, p.rstrip("\n")) for p in paragraphs)


def repaired(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, text): the scanned chunks as continuous paragraphs."""
    ids = small(cut(scanned(documents)))
    rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("document_id").cast("long").alias("document_id"), "text").where("text is not null and chunk_id is not null")
    fixes = noise(chunks, documents).where("kind in ('split', 'misread')").groupBy("chunk_id").agg(F.collect_list(F.struct("kind", "raw", "item")).alias("fixes"))
    held = with_titles(rows, rows.join(ids, "document_id", "left_semi")).dropDuplicates(["chunk_id", "text"]).join(fixes, "chunk_id", "left").select("chunk_id", "text", "titles", "fixes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t, titles, f in zip(*(x.to_pylist() for x in b.columns[1:])):
                f = f or []
                texts.append(mend(t, set(titles or []), {x["raw"]: x["item"] for x in f if x["kind"] == "misread"}, {x["raw"]: x["item"] for x in f if x["kind"] == "split"}))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["chunk_id", "text"])

    return held.mapInArrow(work, "chunk_id long, text string")
