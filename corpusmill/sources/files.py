"""File sources and sinks: inbox, text and office files, registers, logs, exclusion lists, gold sets, snapshots."""

from __future__ import annotations

import fnmatch
import hashlib
import io
import itertools
import json
import os
import re
import shutil
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..models import transcribed
from ..operators.ledger import EXTENSIONS
from ..runtime import create_bytes, exists, names_in, read_bytes, remove, small

#: Limits against archives that unpack to too much.
MAX_ENTRIES, MAX_ENTRY, MAX_RATIO = 5000, 50 * 2**20, 200
SHEET_ROWS, SHEET_COLUMNS = 8000, 64
MANIFEST = "src string, action string, error string, attempt int, ts timestamp"
GOLD = "id string, category string, q string, expected_behaviour string, expect_citations boolean, expect_source string, expected_facts array<string>, domains array<string>, expect_substr string"


def inbox(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(path, rel_path, length, modified, content) of the regular files below ``path``, without hidden folders; candidates only.

    Symbolic links that lead out of a local folder are left out.
    """
    root = os.path.realpath(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + re.escape(root) + "/", "")
    out = files.select("path", rel.alias("rel_path"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    escaped = [os.path.relpath(p, root) for p in _links(root) if not os.path.realpath(p).startswith(root + os.sep)] if os.path.isdir(root) else []
    return candidates(out.where(~F.col("rel_path").isin(escaped)) if escaped else out)


def _links(root: str) -> Iterator[str]:
    for folder, _, names in os.walk(root):
        yield from (p for p in (os.path.join(folder, n) for n in names) if os.path.islink(p))


def candidates(files: DataFrame, done: DataFrame | None = None, retries: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Files of a known extension that are neither hidden nor locks nor done (src); retries (rel_path) count as not done. With a
    ``limit``, the first so many by path."""
    base = F.regexp_extract("rel_path", "([^/]*)$", 1)
    out = files.where(F.lower(F.regexp_extract("rel_path", "\\.([^./]*)$", 1)).isin(EXTENSIONS) & ~base.startswith("~$") & ~F.col("rel_path").rlike("(^|/)\\."))
    if done is not None:
        ended = done.select(F.col("src").alias("rel_path")).distinct()
        out = out.join(small(ended if retries is None else ended.join(retries.select("rel_path"), "rel_path", "left_anti")), "rel_path", "left_anti")
    return out if limit is None else out.orderBy("rel_path").limit(limit)


def plain_text(content: Column) -> Column:
    """UTF-8, bad bytes left out."""
    return F.regexp_replace(F.decode(content, "UTF-8"), "\\x{FFFD}", "")


def safe_archive(infos) -> bool:
    infos = list(infos)
    return len(infos) <= MAX_ENTRIES and all(i.file_size <= MAX_ENTRY and i.file_size <= MAX_RATIO * max(1, i.compress_size) for i in infos)


def office_text(content: bytes) -> str:
    """Texts of the document, sheet, slide and shared parts, one per line; empty for unsafe or broken archives."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if not safe_archive(z.infolist()):
                return ""
            lines = []
            for name in sorted(z.namelist()):
                if name.endswith(".xml") and re.search("document|sheet|slide|shared", name.lower()):
                    try:
                        lines += [e.text for e in ElementTree.fromstring(z.read(name)).iter() if e.text and e.text.strip()]
                    except ElementTree.ParseError:
                        continue
            return "\n".join(lines)
    except (zipfile.BadZipFile, OSError):
        return ""


def cells(content: bytes) -> list[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of a workbook's filled cells, read from its XML; nothing for unsafe archives."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    out: list[tuple[str, int, int, str]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if not safe_archive(z.infolist()):
                return []
            names = set(z.namelist())
            strings = []
            if "xl/sharedStrings.xml" in names:
                strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
            titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet")] if "xl/workbook.xml" in names else []
            dated = date_styles(z, names, ns)
            sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
            for k, n in enumerate(sheets):
                for c in ElementTree.fromstring(z.read(n)).iter(f"{ns}c"):
                    m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                    v = c.find(f"{ns}v")
                    raw = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    if m and raw:
                        col = 0
                        for ch in m[1]:
                            col = col * 26 + ord(ch) - 64
                        out.append((titles[k] if k < len(titles) else n, int(m[2]), col, strings[int(raw)] if c.get("t") == "s" else date_text(raw) if c.get("t") in (None, "n") and int(c.get("s", 0)) in dated else number_text(raw)))
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, OSError):
        return []
    return out


def date_styles(z: zipfile.ZipFile, names: set[str], ns: str) -> set[int]:
    """Numbers of the cell styles that show a date: those of the built-in date formats, or of one with days or years."""
    if "xl/styles.xml" not in names:
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)) for f in root.iter(f"{ns}numFmt") if re.search("[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    cells_ = root.find(f"{ns}cellXfs")
    kinds = [int(x.get("numFmtId", 0)) for x in (cells_ if cells_ is not None else [])]
    return {n for n, k in enumerate(kinds) if k in own or k in (14, 15, 16, 17, 22)}


def date_text(raw: str) -> str:
    """A serial day as year, month and day."""
    try:
        return (pd.Timestamp("1899-12-30") + pd.Timedelta(days=float(raw))).strftime("%Y-%m-%d")
    except (ValueError, OverflowError):
        return raw


def number_text(raw: str) -> str:
    """Whole numbers without a fraction, others to six digits, all else as it is."""
    try:
        x = float(raw)
    except ValueError:
        return raw
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else f"{x:.6g}"


def workbook_cells(files: DataFrame) -> DataFrame:
    """(rel_path, sheet, row, col, value) of all workbooks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *c) for p, x in zip(b.rel_path, b.content) for c in cells(bytes(x))]
            yield pd.DataFrame(rows, columns=["rel_path", "sheet", "row", "col", "value"])

    return files.where(F.lower("rel_path").rlike("\\.xls[xm]$")).select("rel_path", "content").mapInPandas(work, "rel_path string, sheet string, row int, col int, value string")


def sheet_text(cell: DataFrame) -> DataFrame:
    """(rel_path, text): every sheet under its title, cells joined by bars, at most 8,000 rows of 64 cells, then a mark."""
    rows = cell.where(F.col("col") <= SHEET_COLUMNS).groupBy("rel_path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("w"))
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), " | ")
    n = rows.withColumn("n", F.row_number().over(Window.partitionBy("rel_path", "sheet").orderBy("row"))).where(F.col("n") <= SHEET_ROWS + 1)
    text = F.when(F.col("n") > SHEET_ROWS, F.lit("[rows truncated]")).otherwise(line)
    sheets = n.withColumn("line", text).groupBy("rel_path", "sheet").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    one = sheets.select("rel_path", "sheet", F.concat(F.lit("## Sheet: "), "sheet", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("t"))
    return one.groupBy("rel_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "t"))), lambda x: x["t"]), "\n\n").alias("text"))


def register(rows: DataFrame, keyword: str, key: str = "sheet") -> DataFrame:
    """(key, row_no, cells) from (key, row_no, cells array): the header first, then all rows that aren't blank.

    The header is the first row with three filled cells and the keyword; rows are padded or cut to its width without
    trailing blanks; tables without a header give nothing. White space in cells is single.
    """
    neat = F.transform("cells", lambda c: F.coalesce(F.trim(F.regexp_replace(c, "\\s+", " ")), F.lit("")))
    r = rows.select(key, "row_no", neat.alias("cells"))
    filled = F.filter("cells", lambda c: c != "")
    header = (F.size(filled) >= 3) & F.exists("cells", lambda c: F.lower(c).contains(keyword.lower()))
    heads = r.where(header).groupBy(key).agg(F.min_by("cells", "row_no").alias("head"), F.min("row_no").alias("head_no"))
    last = F.array_max(F.transform("head", lambda c, i: F.when(c != "", i + 1).otherwise(0)))
    j = r.join(small(heads.withColumn("width", last)), key).where((F.col("row_no") == F.col("head_no")) | ((F.col("row_no") > F.col("head_no")) & (F.size(filled) > 0)))
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit(""), F.col("width"))), F.lit(1), F.col("width"))
    return j.select(key, "row_no", padded.alias("cells"))


def tsv(registered: DataFrame, key: str = "sheet") -> DataFrame:
    """(key, row_no, line): cells joined by tabs."""
    return registered.select(key, "row_no", F.array_join("cells", "\t").alias("line"))


EXTRACTED = "rel_path string, text string, extractor string, ocr_pages int, error string"
#: A document of fewer characters a page is taken for a scan.
THIN_PAGE = 40


def pdf_text(pages: list) -> tuple[str, list[int]]:
    """(text, characters of each page); pages are texts, or functions that give them, and one that fails is empty."""
    texts = []
    for page in pages:
        try:
            texts.append(((page() if callable(page) else page) or "").strip())
        except Exception:  # one page's failure doesn't take the others
            texts.append("")
    return "\n\n".join(texts), [len(t) for t in texts]


def extracted(files: DataFrame, pdf: Callable[[bytes], list] | None = None, ocr: Callable[[bytes], str] | None = None, images: Callable[[bytes], list] | None = None, registers: list[dict] | None = None, most_pages: int = 25) -> DataFrame:
    """(rel_path, text, extractor, ocr_pages, error) by extension; a file that fails has its error and takes no other with it.

    ``pdf`` gives the texts of a document's pages and ``images`` functions that make pictures of them, ``ocr`` reads a picture.
    Workbooks whose path fits a register's glob and in which its header stands become tab-separated rows, others sheet texts.
    registers: dicts of glob, header_keyword and, if told, sheet.
    """

    def one(path: str, content: bytes) -> tuple[str, str, int]:
        ext = path.rsplit(".", 1)[-1].lower()
        if ext in ("txt", "md", "csv"):
            return content.decode("utf-8", "ignore"), "text", 0
        if ext in ("docx", "pptx"):
            return office_text(content), "office", 0
        if ext == "pdf":
            text, chars = pdf_text(pdf(content)) if pdf else ("", [])
            if ocr and images and (not chars or sum(chars) / len(chars) < THIN_PAGE):
                read, good = transcribed(images(content), ocr, most_pages)
                if len(read) > len(text):
                    return read, "ocr", good
            return text, "text", 0
        read = ocr(content) if ocr else ""
        return read, "ocr", int(bool(read))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for path, content in zip(b.rel_path, b.content):
                try:
                    got.append((path, *one(path, bytes(content)), None))
                except Exception as e:
                    got.append((path, None, None, 0, str(e)[:500]))
            yield pd.DataFrame(got, columns=["rel_path", "text", "extractor", "ocr_pages", "error"])

    book = F.lower("rel_path").rlike("\\.xls[xm]$")
    plain = files.where(~book).select("rel_path", "content").mapInPandas(work, EXTRACTED)
    return plain.unionByName(workbook_texts(files.where(book), registers or []))


def workbook_texts(books: DataFrame, registers: list[dict]) -> DataFrame:
    """Workbooks as ``extracted`` gives them; of several registers that fit the first with a header is taken."""
    cell = workbook_cells(books)
    base = F.regexp_extract("rel_path", "([^/]*)$", 1)
    texts = sheet_text(cell).select("rel_path", F.lit(len(registers)).alias("n"), "text", F.lit("xlsx").alias("extractor"))
    for n, r in enumerate(registers):
        fits = fnmatch.translate(r["glob"]).replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$")
        mine = cell.where(F.col("rel_path").rlike("^" + fits) | base.rlike("^" + fits))
        if r.get("sheet"):
            mine = mine.where(F.col("sheet") == r["sheet"])
        rows = mine.groupBy("rel_path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("w"))
        filled = F.transform(F.sequence(F.lit(1), F.col("w")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
        lines = tsv(register(rows.select(F.to_json(F.array("rel_path", "sheet")).alias("k"), F.col("row").alias("row_no"), filled.alias("cells")), r.get("header_keyword", ""), "k"), "k")
        sheets = lines.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
        told = sheets.select(F.from_json("k", "array<string>").alias("k"), "text").groupBy(F.col("k")[0].alias("rel_path")).agg(F.min_by("text", F.col("k")[1]).alias("text"))
        texts = texts.union(told.select("rel_path", F.lit(n), "text", F.lit("xlsx-register")))
    best = texts.groupBy("rel_path").agg(F.min_by(F.struct("text", "extractor"), "n").alias("t"))
    return books.select("rel_path").join(best, "rel_path", "left").select("rel_path", F.coalesce("t.text", F.lit("")).alias("text"), F.coalesce("t.extractor", F.lit("xlsx")).alias("extractor"), F.lit(0).alias("ocr_pages"), F.lit(None).cast("string").alias("error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The attempt log; lines that can't be read are left out."""
    return spark.read.schema(MANIFEST + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null and src is not null").drop("_bad")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """rel_path of the exclusion list, without comments and blank lines."""
    line = F.trim(F.split("value", "#")[0])
    return spark.read.text(path).select(line.alias("rel_path")).where("rel_path <> ''").distinct()


def append_exclusions(paths: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """Adds the paths that aren't listed yet; with ``dry_run`` only gives them."""
    spark = paths.sparkSession
    new = paths.select("rel_path").distinct()
    if exists(spark, path):
        new = new.join(small(exclusions(spark, path)), "rel_path", "left_anti")
    if not dry_run:
        new.select(F.col("rel_path").alias("value")).write.mode("append").text(path)
    return new


def gold_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a gold set in JSON lines; blank lines, comments and what isn't JSON are left out."""
    rows = spark.read.text(path).select(T.strip(F.col("value")).alias("line")).where("line <> '' and not startswith(line, '#') and try_parse_json(line) is not null")
    return rows.select(F.from_json("line", GOLD).alias("g")).select("g.*").where("q is not null").withColumnRenamed("id", "gold_id")


def promoted_names(files: DataFrame) -> DataFrame:
    """(…, dest): names in the curated store for (rel_path, dir, base, sha256): the first of a name keeps it, others get ``__`` and eight digits of the digest, then a number."""
    root, ext = F.regexp_extract("base", "^(.+?)(\\.[^.]*)?$", 1), F.regexp_extract("base", "^(.+?)(\\.[^.]*)?$", 2)
    w = Window.partitionBy("dir", "base").orderBy("rel_path")
    v = Window.partitionBy("dir", "base", "sha256").orderBy("rel_path")
    n = files.withColumn("n", F.row_number().over(w)).withColumn("m", F.row_number().over(v))
    short = F.concat(root, F.lit("__"), F.substring("sha256", 1, 8))
    first_sha = F.first("sha256").over(w)
    name = F.when(F.col("n") == 1, F.col("base")).when((F.col("m") == 1) & (F.col("sha256") != first_sha), F.concat(short, ext)).otherwise(F.concat(short, F.lit("_"), F.col("n").cast("string"), ext))
    return n.withColumn("dest", F.concat_ws("/", "dir", name)).drop("n", "m")


def digest_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(2**20):
            h.update(block)
    return h.hexdigest()


def verified_file(path: str, sha256: str) -> bool:
    """A regular file, no link, with just this content."""
    return os.path.isfile(path) and not os.path.islink(path) and digest_of(path) == sha256


def promote(source: str | bytes, dest: str, sha256: str) -> str:
    """Copies a file, or writes its content, into the curated store: a temporary copy, flushed, checked against its digest, then renamed.

    A taken name with other content gets ``__`` and eight digits of the digest, then a number. Gives the name used; a file
    that is there already isn't copied again.
    """
    root, ext = os.path.splitext(dest)
    names = itertools.chain([dest, f"{root}__{sha256[:8]}{ext}"], (f"{root}__{sha256[:8]}_{n}{ext}" for n in itertools.count(2)))
    for name in names:
        if not os.path.exists(name):
            break
        if digest_of(name) == sha256:
            return name
    os.makedirs(os.path.dirname(name) or ".", exist_ok=True)
    part = f"{name}.part-{uuid.uuid4().hex[:8]}"
    try:
        if isinstance(source, bytes):
            with open(part, "wb") as f:
                f.write(source)
        else:
            shutil.copyfile(source, part)
        with open(part, "rb+") as f:
            os.fsync(f.fileno())
        if digest_of(part) != sha256:
            raise OSError(f"digest changed on the way to {dest}")
        os.replace(part, name)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return name


def quarantine(source: str, folder: str, sha256: str) -> str:
    """Promotes a file into quarantine, then removes it from the inbox."""
    name = promote(source, os.path.join(folder, os.path.basename(source)), sha256)
    os.remove(source)
    return name


class Busy(RuntimeError):
    """Another writer holds the store, or has changed it meanwhile."""


class Snapshots:
    """Tables as immutable folders, the segments, and numbered versions that list each table's segments: readers see all of a
    commit or nothing, and a commit writes no more than what is new. All through the Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[str]:
        return [n for n in names_in(self.spark, self.root) if re.fullmatch(r"version-\d{10}\.json", n)]

    def current(self) -> dict[str, list[str]]:
        known = self._versions()
        return json.loads(read_bytes(self.spark, f"{self.root}/{known[-1]}")) if known else {}

    def read(self, name: str) -> DataFrame | None:
        at = self.current().get(name)
        return self.spark.read.parquet(*(f"{self.root}/{x}" for x in at)) if at else None

    def commit(self, append: dict[str, DataFrame] | None = None, **replace: DataFrame) -> None:
        """Appends to tables, or replaces them by name: first all segments are written, then the next version, which can be only once."""
        known = self._versions()
        new = json.loads(read_bytes(self.spark, f"{self.root}/{known[-1]}")) if known else {}
        for name, df, kept in [*((n, df, True) for n, df in (append or {}).items()), *((n, df, False) for n, df in replace.items())]:
            segment = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{segment}")
            new[name] = [*(new.get(name, []) if kept else []), segment]
        number = int(re.findall(r"\d+", known[-1])[0]) + 1 if known else 0
        if not create_bytes(self.spark, f"{self.root}/version-{number:010d}.json", json.dumps(new).encode()):
            raise Busy("the store was changed meanwhile")

    def compact(self, most: int = 64) -> None:
        """Tables of more than ``most`` segments are written as one."""
        many = [n for n, at in self.current().items() if len(at) > most]
        if many:
            self.commit(**{n: self.read(n) for n in many})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes the segments that the last ``keep`` versions don't list, and older versions; gives their names."""
        versions = self._versions()
        live = {x for v in versions[-keep:] for at in json.loads(read_bytes(self.spark, f"{self.root}/{v}")).values() for x in at}
        gone = [n for n in names_in(self.spark, self.root) if n in versions[:-keep] or (re.fullmatch(r"\w+-[0-9a-f]{32}", n) and n not in live)]
        for n in gone:
            remove(self.spark, f"{self.root}/{n}")
        return gone

    @contextmanager
    def writing(self, lease: float = 6 * 3600):
        """The only writer, for so long; a lock older than the lease belonged to one that died."""
        at, mine = f"{self.root}/WRITER", json.dumps({"holder": uuid.uuid4().hex, "until": time.time() + lease}).encode()
        if not create_bytes(self.spark, at, mine):
            if json.loads(read_bytes(self.spark, at) or b"{}").get("until", 0) > time.time():
                raise Busy("another writer holds the store")
            remove(self.spark, at)
            if not create_bytes(self.spark, at, mine):
                raise Busy("another writer holds the store")
        try:
            yield self
        finally:
            if read_bytes(self.spark, at) == mine:
                remove(self.spark, at)

    def copy(self, to: str) -> dict:
        """A backup of the current version, verified; it has a version, and so is a store, only when it is complete."""
        now = self.current()
        for at in {x for segments in now.values() for x in segments}:
            self.spark.read.parquet(f"{self.root}/{at}").write.mode("overwrite").parquet(f"{to}/{at}")
        other = Snapshots(self.spark, to)
        if not create_bytes(self.spark, f"{to}/version-{0:010d}.json", json.dumps(now).encode()):
            raise Busy(f"there is a store in {to}")
        told = other.report()
        if not told["ok"]:
            remove(self.spark, f"{to}/version-{0:010d}.json")
            raise RuntimeError(f"the backup doesn't verify: {told}")
        return told

    def restore(self, source: str) -> dict:
        """Makes a verified backup the current version of this store; what was current stays below it until a vacuum."""
        backup = Snapshots(self.spark, source)
        told = backup.report()
        if told["ok"]:
            self.commit(**{n: backup.read(n) for n in backup.current()})
        return told

    def report(self) -> dict:
        """ok, and counts: chunks and vectors are the same, every chunk's document is there, n_chunks is right."""
        docs, chunks, vectors = (self.read(n) for n in ("documents", "chunks", "vchunks"))
        if docs is None or chunks is None or vectors is None:
            return {"ok": False, "error": "a table is missing"}
        ids, v = chunks.select("chunk_id", "document_id").distinct(), vectors.select("chunk_id").distinct()
        orphans = ids.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti").count()
        apart = ids.select("chunk_id").join(v, "chunk_id", "left_anti").count() + v.join(ids, "chunk_id", "left_anti").count()
        held = ids.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n"))
        wrong = docs.join(held, "doc_id", "left").where(F.coalesce("n", F.lit(0)) != F.coalesce("n_chunks", F.lit(0))).count()
        counts = {"documents": docs.count(), "chunks": ids.count(), "vchunks": v.count()}
        return {"ok": orphans == apart == wrong == 0, "counts": counts, "orphans": orphans, "apart": apart, "chunk_mismatches": wrong}

    def verified(self) -> bool:
        return self.report()["ok"]
