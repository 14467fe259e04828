import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill import models
from corpusmill.operators import ledger
from corpusmill.sources import files
from corpusmill.streaming import ingest


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [["Cable Schedule"], [], ["Cable Number", "From", "To", "Note"], ["C1", "A", "B"], [], ["C2", "B", "C", "x\ny", "beyond"]]
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    xml = f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", xml)


def dated_workbook(rows):
    """Content of a workbook whose numbers are dates."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" s="1"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(65 + c)}{r + 1}" t="inlineStr"><is><t>{v}</t></is></c>'
    xml = f"<worksheet {ns}><sheetData>" + "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v != "") + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S1"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", xml)
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    return out.getvalue()


def test_inbox_registers_and_office_text(spark, tmp_path):
    box = tmp_path / "in"
    (box / "sub").mkdir(parents=True)
    workbook(box / "a.xlsx")
    (box / "sub" / "b.txt").write_bytes(b"plain \xff text")
    (box / "~$b.txt").write_text("lock")
    (box / ".hidden.txt").write_text("h")
    (box / "c.exe").write_text("e")
    found = files.inbox(spark, str(box))
    assert sorted(r.rel_path for r in found.collect()) == ["a.xlsx", "sub/b.txt"]
    cells = files.workbook_cells(found)
    rows = cells.groupBy("sheet", F.col("row").alias("row_no")).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    rows = rows.select("sheet", "row_no", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.try_element_at("m", i)).alias("cells"))
    lines = [r.line for r in files.tsv(files.register(rows, "cable")).orderBy("row_no").collect()]
    assert lines == ["Cable Number\tFrom\tTo\tNote", "C1\tA\tB\t", "C2\tB\tC\tx y"]
    texts = {r.rel_path: (r.text, r.extractor) for r in files.extracted(found).collect()}
    assert texts["sub/b.txt"] == ("plain  text", "text") and "Cable Number" in texts["a.xlsx"][0]
    assert files.sheet_text(cells).first().text.startswith("## Sheet: S1\nCable Schedule")


def test_unsafe_archives_give_nothing():
    class Info:
        def __init__(self, size, packed):
            self.file_size, self.compress_size = size, packed

    assert not files.safe_archive([Info(51 * 2**20, 2**20)]) and not files.safe_archive([Info(1, 1)] * 5001) and not files.safe_archive([Info(2010, 10)])
    assert files.safe_archive([Info(1000, 100)]) and files.office_text(b"not a zip") == ""


def test_lists_logs_and_gold(spark, tmp_path):
    (tmp_path / "ex.txt").write_text("# head\na/b.pdf  # old\n\nc.md\n")
    assert sorted(r[0] for r in files.exclusions(spark, str(tmp_path / "ex.txt")).collect()) == ["a/b.pdf", "c.md"]
    (tmp_path / "g.jsonl").write_text('# c\n\n{"q": "x", "id": "1"}\nnot json\n{"id": "2"}\n')
    assert [r.gold_id for r in files.gold_items(spark, str(tmp_path / "g.jsonl")).collect()] == ["1"]
    (tmp_path / "m.jsonl").write_text('{"src": "a", "action": "error"}\nbroken\n{"action": "x"}\n')
    assert [r.src for r in files.manifest(spark, str(tmp_path / "m.jsonl")).collect()] == ["a"]


def test_ingest_is_restartable(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.txt").write_text("The pump must be drained before work begins.")
    (box / "b.txt").write_text("The pump must be drained before work begins.")
    (box / "c.txt").write_text("tiny")
    (box / "d.txt").write_text("the password = hunter2-long is written here")
    run = lambda: ingest.run(spark, str(box), str(tmp_path / "store"), str(tmp_path / "cp"))
    run()
    store = files.Snapshots(spark, str(tmp_path / "store"))
    actions = {r.src: r.action for r in store.read("manifest").collect()}
    assert actions == {"a.txt": "processed", "b.txt": "skip_duplicate", "c.txt": "skip_empty", "d.txt": "quarantine_secret"}
    (box / "e.txt").write_text("Another document about the chiller and its valves.")
    run()
    run()
    assert store.read("documents").count() == 2 and store.verified()
    store.copy(str(tmp_path / "backup"))
    backup = files.Snapshots(spark, str(tmp_path / "backup"))
    assert backup.verified() and backup.report()["counts"] == store.report()["counts"]
    store.commit(documents=store.read("documents").limit(1))
    assert not store.verified() and store.restore(str(tmp_path / "backup"))["ok"] and store.verified()
    assert store.vacuum(1) and store.verified()


def test_promotion_and_quarantine(tmp_path):
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    one, two = files.digest_of(tmp_path / "a.txt"), files.digest_of(tmp_path / "b.txt")
    dest = str(tmp_path / "cur" / "x.txt")
    assert files.promote(str(tmp_path / "a.txt"), dest, one) == dest == files.promote(str(tmp_path / "a.txt"), dest, one)
    assert files.promote(str(tmp_path / "b.txt"), dest, two) == str(tmp_path / "cur" / f"x__{two[:8]}.txt")
    files.quarantine(str(tmp_path / "a.txt"), str(tmp_path / "q"), one)
    assert not (tmp_path / "a.txt").exists() and (tmp_path / "q" / "a.txt").read_text() == "one"


def test_one_bad_file_takes_no_other_and_is_given_up_at_the_third_error(spark, tmp_path):
    box, cur = tmp_path / "in", tmp_path / "cur"
    box.mkdir()
    (box / "bad.pdf").write_bytes(b"x")
    (box / "good.txt").write_text("The fan must be cleaned before the season begins.")

    def pdf(content):
        raise ValueError("no document")

    run = lambda: ingest.run(spark, str(box), str(tmp_path / "store"), str(tmp_path / "cp"), str(cur), pdf=pdf)
    store = files.Snapshots(spark, str(tmp_path / "store"))
    for n in (1, 2, 3, 4):
        run()
        log = sorted((r.action, r.attempt) for r in store.read("manifest").where("src = 'bad.pdf'").collect())
        assert log == sorted([("error", 1), ("error", 2), ("dead_letter", 3)][: min(n, 3)])
    assert {r.src_path: r.state for r in ingest.pending(store).collect()} == {"good.txt": "indexed", "bad.pdf": "dead_letter"}
    assert (cur / "99_MISC" / "good.txt").exists() and store.read("documents").first().rel_path == "99_MISC/good.txt"
    store.commit({"manifest": ledger.retry_requests(spark.createDataFrame([("bad.pdf",)], "src string")).selectExpr("src", "action", "string(null) as error", "int(null) as attempt", "array('') as warnings", "ts")})
    run()
    assert store.read("manifest").where("src = 'bad.pdf' and action = 'error'").count() == 3


def test_a_duplicate_whose_copy_is_gone_is_taken_in_anew(spark, tmp_path):
    box, cur = tmp_path / "in", tmp_path / "cur"
    box.mkdir()
    (box / "a.txt").write_text("The belt must be changed before the season begins.")
    run = lambda: ingest.run(spark, str(box), str(tmp_path / "store"), str(tmp_path / "cp"), str(cur), quarantine=str(tmp_path / "hidden"), clean=True)
    (box / "key.txt").write_text("the password = hunter2-long is written here")
    (box / "tiny.txt").write_text("tiny")
    run()
    assert sorted(p.name for p in box.iterdir() if not p.name.startswith(".")) == ["tiny.txt"] and (tmp_path / "hidden" / "key.txt").exists()
    (box / "b.txt").write_text("The belt must be changed before the season begins.")
    run()
    store = files.Snapshots(spark, str(tmp_path / "store"))
    (cur / "99_MISC" / "a.txt").unlink()
    (box / "c.txt").write_text("The belt must be changed before the season begins.")
    run()
    actions = {r.src: r.action for r in store.read("manifest").collect()}
    assert actions == {"a.txt": "processed", "b.txt": "skip_duplicate", "c.txt": "processed", "key.txt": "quarantine_secret", "tiny.txt": "skip_empty"}
    assert [r.rel_path for r in store.read("documents").collect()] == ["99_MISC/c.txt"] and store.verified()


def test_what_a_run_left_half_done_is_put_right(spark, tmp_path):
    box, cur = tmp_path / "in", tmp_path / "cur"
    box.mkdir()
    cur.mkdir()
    (box / "a.txt").write_text("The hose must be rolled before the season begins.")
    digest = files.digest_of(str(box / "a.txt"))
    store = files.Snapshots(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([("a.txt", "a.txt", "99_MISC/a.txt", digest, "staged", None), ("lost.txt", "lost.txt", "99_MISC/lost.txt", "0" * 64, "curated", None)], "src_path string, rel_path string, dest_rel_path string, sha256 string, state string, error string")
    store.commit({"ingest_pending": rows.selectExpr("*", "current_timestamp() as updated_at")})
    ingest.run(spark, str(box), str(tmp_path / "store"), str(tmp_path / "cp"), str(cur))
    assert {r.src_path: r.state for r in ingest.pending(store).collect()} == {"a.txt": "indexed", "lost.txt": "dead_letter"}
    assert store.read("documents").count() == 1 and store.verified()


def test_only_one_writes_and_no_commit_is_lost(spark, tmp_path):
    a, b = (files.Snapshots(spark, str(tmp_path / "store")) for _ in range(2))
    with a.writing():
        with pytest.raises(files.Busy):
            with b.writing():
                pass
    with b.writing(lease=-1):  # its holder died long ago
        with a.writing():
            pass
    b._versions = lambda: []  # as if it had looked before the other's commit
    a.commit(documents=spark.range(1))
    with pytest.raises(files.Busy):
        b.commit(documents=spark.range(2))
    a.commit({"documents": spark.range(3)})
    assert a.read("documents").count() == 4 and len(a.current()["documents"]) == 2
    a.compact(1)
    assert a.read("documents").count() == 4 and len(a.current()["documents"]) == 1


def test_pages_registers_and_dates(spark):
    def page(n):
        def make():
            if n == 2:
                raise OSError("torn")
            return b"%d" % n
        return make

    pages = [page(n) for n in range(1, 5)]
    assert models.transcribed(pages, lambda png: f"text {png.decode()}", 3) == ("[Page 1] text 1\n\n[OCR error on page 2: torn]".replace("[OCR", "[Page 2] [OCR") + "\n\n[Page 3] text 3\n\n[NOTE: OCR limited to first 3 of 4 pages]", 2)
    assert models.described(pages, lambda png: "seen", 2) == "[Page 1] seen\n\n[NOTE: described first 2 of 4 pages]"
    assert files.pdf_text(["a", lambda: 1 / 0, "bc "]) == ("a\n\n\n\nbc", [1, 0, 2])
    assert files.date_text("45292") == "2024-01-01"
    book = dated_workbook([["List", "", ""], ["Serial No", "Make", "Day"], ["S1", "Acme", 45292]])
    df = spark.createDataFrame([("r/reg_1.xlsx", book), ("other.xlsx", book), ("broken.xlsx", b"no"), ("t.pdf", b"3")], "rel_path string, content binary")
    got = {r.rel_path: (r.text, r.extractor) for r in files.extracted(df, pdf=lambda c: ["x"], images=lambda c: [lambda: c], ocr=lambda png: "a long text of a scan", registers=[{"glob": "*/reg_*.xlsx", "header_keyword": "serial"}]).collect()}
    assert got["r/reg_1.xlsx"] == ("Serial No\tMake\tDay\nS1\tAcme\t2024-01-01", "xlsx-register") and got["other.xlsx"][1] == "xlsx" and got["broken.xlsx"] == ("", "xlsx")
    assert got["t.pdf"] == ("[Page 1] a long text of a scan", "ocr")
