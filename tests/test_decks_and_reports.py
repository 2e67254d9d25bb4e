import datetime as dt
import io
import json
import zipfile

from pyspark.sql import functions as F

from docloom.functions import digest
from docloom.operators import reports, structure
from docloom.plans import package
from docloom.sources import pptx

NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def at(x, y, w, h, tag="a:xfrm", more=""):
    return f'<{tag}><a:off x="{x * 12700}" y="{y * 12700}"/><a:ext cx="{w * 12700}" cy="{h * 12700}"/>{more}</{tag}>'


def text(t, size=""):
    return "<p:txBody>" + "".join(f'<a:p><a:r><a:rPr sz="{size}"/><a:t>{x}</a:t></a:r></a:p>' for x in t.split("|")) + "</p:txBody>"


def shape(t, box="", ph="", geometry="", name="s", size="1800"):
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr>{box}{geometry}</p:spPr>{text(t, size) if t else ""}</p:sp>'


def deck(*slides):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        ids = "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{960 * 12700}" cy="{540 * 12700}"/></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", '<R xmlns="x">' + "".join(f'<Relationship Id="r{i}" Type="a/slide" Target="slides/s{i}.xml"/>' for i in range(len(slides))) + "</R>")
        for i, s in enumerate(slides):
            z.writestr(f"ppt/slides/s{i}.xml", f"<p:sld {NS}><p:cSld><p:spTree>{s}</p:spTree></p:cSld></p:sld>")
            z.writestr(f"ppt/slides/_rels/s{i}.xml.rels", '<R xmlns="x"><Relationship Id="i1" Type="a/image" Target="../media/a.PNG"/><Relationship Id="n" Type="a/notesSlide" Target="../notes/n.xml"/></R>')
        z.writestr("ppt/media/a.PNG", b"picture")
        z.writestr("ppt/notes/n.xml", f'<p:notes {NS}>{shape("say this", ph="<p:ph type=" + chr(34) + "body" + chr(34) + "/>")}</p:notes>')
    return b.getvalue()


RECT = '<a:prstGeom prst="roundRect"/><a:solidFill><a:srgbClr val="112233"/></a:solidFill>'
GROUP = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="9" name="g"/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr>{at(100, 200, 400, 100, more=f"""<a:chOff x="0" y="0"/><a:chExt cx="{200 * 12700}" cy="{50 * 12700}"/>""")}</p:grpSpPr>{shape("1. one", at(0, 0, 50, 50), geometry=RECT)}{shape("2. two", at(100, 0, 50, 50), geometry=RECT)}</p:grpSp>'
PICTURE = '<p:pic><p:nvPicPr><p:cNvPr id="3" name="x" descr="alt"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="i1"/></p:blipFill></p:pic>'
TABLE = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="t"/><p:nvPr/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl><a:tblPr firstRow="1"/>' + "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in row) + "</a:tr>" for row in ("ab", "12")) + "</a:tbl></a:graphicData></a:graphic></p:graphicFrame>"


def test_deck(spark):
    raw = deck(shape("Deck", ph='<p:ph type="ctrTitle"/>') + shape("about", ph='<p:ph type="subTitle"/>') + shape("9", ph='<p:ph type="sldNum"/>'), shape("Small", at(0, 10, 9, 9), size="1200") + shape("Work", at(0, 20, 9, 9), size="3200") + GROUP, TABLE + PICTURE + PICTURE)
    decks = spark.createDataFrame([(1, raw), (2, b"broken"), (3, None)], "page_id int, content binary")
    rows = pptx.elements(decks).orderBy("slide_no", "el_no").collect()
    assert {r.page_id for r in rows} == {1}
    assert [(r.slide_no, r.type, r.role, r.lines) for r in rows[:6]] == [(1, "text", "title", ["Deck"]), (1, "text", "subtitle", ["about"]), (2, "text", "body", ["Small"]), (2, "text", "title", ["Work"]), (2, "shape", None, ["1. one"]), (2, "shape", None, ["2. two"])]
    assert (rows[5].x, rows[5].y, rows[5].w, rows[5].h, rows[5].shape) == (300.0, 200.0, 100.0, 100.0, "rounded_rect")
    assert rows[6].cells == [["a", "b"], ["1", "2"]] and rows[6].header_rows == 1 and [r.src for r in rows[7:]] == ["img001.png"] * 2 and rows[7].alt == "alt" and rows[0].notes == "say this"
    assert [r.layout for r in (rows[0], rows[2], rows[6])] == ["title", "title_body", "table"]
    kinds = {r.slide_no: r.kind for r in structure.classified(structure.slides(pptx.elements(decks))).collect()}
    assert kinds == {1: "title_only", 2: "flow", 3: "table"}


def test_image_assets(spark):
    pages = spark.createDataFrame([(1, '<img src="data:image/gif;base64,aGk="><img src="x.png">'), (2, '<img src="data:image/gif;base64,aGk=">'), (3, "<img src='data:,a%20b'>")], "page_id int, html string")
    assert {(r.mime, r.first_page, r.n) for r in pptx.image_assets(pages).collect()} == {("image/gif", 1, 2), ("image/png", 3, 1)}


def test_reports(spark, tmp_path):
    outcomes = spark.createDataFrame([(f"f{i:03d}", "error" if i else "ok", "why" if i % 2 else "", 2, 1) for i in range(130)], "relative_path string, status string, reason string, units_total int, units_ok int")
    findings = spark.createDataFrame([("email", 3)], "kind string, hits long")
    groups = spark.createDataFrame([("a", "g", True), ("b", "g", False)], "relative_path string, grp string, keep boolean")
    rows = {(r.section, r.nth): r.line for r in reports.coverage_report(outcomes, findings, groups).collect()}
    assert rows["status", 1] == "error: 129" and rows["coverage", 1] == "130 of 260 units" and rows["trouble", 1] == "f001 - error - why" and rows["trouble", 101] == "... 29 more"
    assert rows["sensitive", 1] == "email: 3" and [rows["duplicates", i] for i in (1, 2)] == ["a (kept)", "b"]
    d = digest.digest(spark.createDataFrame([(1, "第1章 総則\n別紙2参照 2019年4月")], "doc_id long, text string")).withColumn("text", F.lit("a ``` b"))
    page = d.select(reports.digest_page(F.lit("n"), F.col("text"), F.col("headings"), F.col("newest_year"), F.col("date_mentions"), F.col("broken_references"), F.col("avg_sentence_length"), F.lit(dt.date(2024, 1, 1)))).first()[0]
    assert "- 1 総則" in page and "- newest year: 2019\n- missing: 別紙2" in page and "````text\na ``` b\n````" in page
    chunk = spark.createDataFrame([(1, "f", 1, 2, "p/f", "3 B", "")], "index int, file_name string, chunk_index int, chunk_count int, relative_path string, size_text string, text string")
    r = reports.markdown_sections(chunk).first()
    assert r.text.startswith("## f (1/2)\n- path: p/f") and r.size == len(r.text)
    (tmp_path / "m.json").write_text(json.dumps({"name": "m", "target_chars_per_file": 5, "max_body_files": 2, "notes": []}, indent=1))
    assert package.read_profiles(spark, str(tmp_path)) == [package.Profile("m", 5, 2)]
    chunks = spark.createDataFrame([(i, "x" * 3) for i in range(1, 4)], "index int, text string")
    assert [r.part for r in package.profile_package(chunks, package.Profile("m", 5, 2)).orderBy("index").collect()] == [1, 2, None]
