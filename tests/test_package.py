import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.plans import package as pk
from docloom.sources import files, readers


def zipped(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return b.getvalue()


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DOCX = zipped({
    "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="H2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": f'<w:styles xmlns:w="{WORD}"><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
})
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def xlsx(cells, second="<bad"):
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{LINK}"><sheets><sheet name="S1" r:id="r1"/><sheet name="S2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<R xmlns="x"><Relationship Id="r1" Type="a/worksheet" Target="worksheets/s1.xml"/><Relationship Id="r2" Type="a/worksheet" Target="worksheets/s2.xml"/></R>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><t>hey</t></si></sst>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="{SHEET}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": second,
    })


def test_readers():
    got = readers.extract(DOCX, "a.docx")
    assert (got.text, got.status) == ("## Head\nHello you\na | b", "ok")
    got = readers.extract(xlsx('<c r="A1" t="s"><v>0</v></c><c r="B1"><v>3.5</v></c>'), "b.xlsx")
    assert got.text == "# Sheet: S1\nRow 1: A1=hey | B1=3.5\n# Sheet: S2" and (got.status, got.units_ok, got.units_total) == ("partial", 1, 2)
    got = readers.extract(xlsx("", f'<worksheet xmlns="{SHEET}"/>'), "b.xlsm")
    assert got.status == "empty"
    got = readers.extract(zipped({"x/b.txt": "こんにちは".encode("cp932"), "a.docx": DOCX, "c.png": b"1", "d.xlsx": b"bad"}), "q.zip")
    assert got.units_total == 3 and "こんにちは" in got.text and got.text.index("a.docx") < got.text.index("b.txt") and "c.png" not in got.text
    assert readers.extract(readers.OLE_MAGIC + b"x", "e.xlsx").status == "protected"
    assert [readers.extract(b"x", n).status for n in ("g.exe", "g.doc", "g.zip", "g.docx")] == ["unsupported", "needs_conversion", "error", "error"]
    assert readers.extract(b" \n", "f.txt").status == "empty"
    assert readers.cell_name(3, 28) == "AB3"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("root")
    lines = "\n".join(f"Line {i} of the manual tells how part {i * 7} is cleaned and checked." for i in range(40))
    for name, data in {
        "a.txt": lines, "old/a copy.txt": lines + "\nOne more line.", "b.txt": "call 090-1234-5678 or mail me@example.org", "sub/c.docx": DOCX, "sub/long.txt": "word " * 9000,
        "~$b.txt": "lock", "管理/x.txt": "no", "pic.png": b"1", "_AI_CONTEXT_x.txt": "own", "z.doc": b"old",
    }.items():
        p = root / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


def test_scan(spark, folder):
    rows = {r.relative_path: r.skip for r in files.scan(files.listed(spark, folder), folder).collect()}
    assert {k: v for k, v in rows.items() if v} == {"~$b.txt": "temp", "管理/x.txt": "excluded", "pic.png": "extension"}
    counts = {r.extension: r.n_files for r in files.scan_counts(files.scan(files.listed(spark, folder), folder)).collect()}
    assert counts == {".txt": 4, ".docx": 1, ".doc": 1}


def test_package_end_to_end(spark, folder, tmp_path):
    options = pk.Options(folder, str(tmp_path / "out"), chunk_chars=2000, part_capacity=9000, max_parts=3)
    got = pk.build(spark, options)
    status = {r.relative_path: r.status for r in got.outcomes.collect()}
    assert status.pop("z.doc") == "needs_conversion" and sorted(status.values()) == ["dedupe_excluded", "ok", "ok", "ok", "ok"]
    chunks = got.chunks.orderBy("index").collect()
    assert [r["index"] for r in chunks] == list(range(1, len(chunks) + 1))
    assert all(len(r.text) <= 2000 and r.chunk_index <= r.chunk_count for r in chunks)
    text = next(r.text for r in chunks if r.relative_path == "b.txt")
    assert text == "call ＜伏字＞ or mail ＜伏字＞"
    assert {r.kind: r.hits for r in got.findings.collect()} == {"phone": 1, "email": 1}
    parts = got.parts.collect()
    assert {r.part for r in parts} == {1, 2, 3, None}
    assert {r.section for r in pk.index_rows(got).collect()} == {"file", "excluded", "overflow"}
    score = pk.report(got, F.current_date()).first()
    assert score.capacity == 0 and score.safety == 4 and score.readable == 27
    first = pk.publish_package(spark, got, options)
    assert first["publish"] and first["reason"] == "first run"
    again = pk.publish_package(spark, got, options)
    assert again["publish"] and again["folder"] == pk.published(spark, options.out) and spark.read.json(f"{again['folder']}/upload_note").select("state").distinct().collect()[0][0] == "unchanged"
    held = pk.publish_package(spark, got, options, stopped=True)
    assert not held["publish"] and spark.read.json(f"{options.out}/hold_notice").first().reason == "hold: stopped"
    assert spark.read.json(f"{pk.published(spark, options.out)}/chunks").count() == len(chunks)
    assert pk.dry_run(got).first().n_chunks == len(chunks)


def test_modes(spark, folder, tmp_path):
    options = pk.Options(folder, str(tmp_path / "out"), sensitive="block", dedupe="warn", priority=("sub",))
    got = pk.build(spark, options)
    chunks = got.chunks.orderBy("index").collect()
    assert "b.txt" not in {r.relative_path for r in chunks} and chunks[0].relative_path.startswith("sub/")
    assert {"a.txt", "old/a copy.txt"} <= {r.relative_path for r in chunks}
    plain = pk.build(spark, options.legacy()).chunks.collect()
    assert any("090-1234-5678" in r.text for r in plain)
