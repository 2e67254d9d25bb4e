import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import color, records
from docloom.operators import prompts, reports, structure
from docloom.sources import html, kinds, theme

CSS = """<style>/* x{} */ :root{--brand:#0a7; --loop:var(--loop)} body{background:#fff;color:rgb(1,2,3)} h1, h2.x {color: var(--brand)}
.card.big{background-color:var(--none, #ABCDEF)} td{border:1px solid #123456} .note{color:var(--loop)} body{font-family:"Noto Sans", serif}</style>
<body><h1 style="font-family: Arial">T</h1><p class="note" style="color:#ff0000">x</p></body>"""


def test_theme(spark):
    t = theme.theme_of(CSS)
    assert t["colors"] == {"background": "#FFFFFF", "text": "#010203", "heading": "#00AA77", "card": "#ABCDEF", "line": "#123456", "accent": "#FF0000"}
    assert t["sources"]["card"] == ".card.big" and t["sources"]["accent"] == "most vivid"
    assert t["fonts"] == {"body": "Noto Sans"} and t["palette"] == ["#010203", "#FFFFFF", "#00AA77", "#ABCDEF", "#123456", "#FF0000"]
    pages = spark.createDataFrame([(1, CSS), (2, None), (3, '<link rel="stylesheet" href="a.css">')], "page_id int, html string")
    rows = {r.page_id: r for r in theme.themes(pages).collect()}
    assert rows[1].colors["heading"] == "#00AA77" and rows[2].colors == {} and rows[3].external_css == 1


@pytest.mark.parametrize("steps, want", [([("shade", 0.5)], "#00BC00"), ([], "#00FF00"), ([("lumMod", 0.5)], "#008000"), ([("inv", 0.0)], "#FF00FF"), ([("gray", 0.0)], "#969696"), ([("lumMod", 0.4), ("lumOff", 0.6)], "#99FF99"), ([("hueOff", 120.0)], "#0000FF"), ([("satMod", 0.0)], "#808080"), ([("tint", 0.0)], "#FFFFFF")])
def test_colour_steps(spark, steps, want):
    rows = spark.createDataFrame([("#00FF00", [{"op": a, "value": b} for a, b in steps]), (None, None)], "c string, s array<struct<op:string,value:double>>")
    assert [r[0] for r in rows.select(color.transformed(F.col("c"), F.col("s"))).collect()] == [want, None]


def archive(*names):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in names:
            z.writestr(n, n)
    return b.getvalue()


def test_file_kinds(spark):
    assert kinds.kind_of(archive("[Content_Types].xml", "ppt/a.xml")) == "pptx" and kinds.kind_of(archive("a.html")) == "html"
    assert kinds.kind_of(b"<!DOCTYPE html>") == "html" and kinds.kind_of(b"x", "a.HTM") == "html"
    assert [kinds.kind_of(b"x", n)[:5] for n in ("a.pptx", "b.txt")] == ["error", "error"] and kinds.kind_of(b"PKx").startswith("error")
    name, page, files = kinds.page_of_archive(archive("b/index.html", "z.html", "a.htm", "Index.html", "__MACOSX/a.html", "p.png"))
    assert (name, page, len(files)) == ("Index.html", b"Index.html", 5) and kinds.page_of_archive(archive("x.txt")) is None
    rows = spark.createDataFrame([(b"PK12", "x"), (b"\xff\xfe <HTML", "x"), (b"x", "a.htm"), (b"", "x")], "b binary, n string")
    assert [r[0] for r in rows.select(kinds.plain_kind(F.col("b"), F.col("n"))).collect()] == ["zip", "html", "html", "unknown"]


def test_saved_records(spark):
    rows = ['{"v":2,"app":"g","state":"s"}', '{"v":3,"app":"g"}', '{"v":1,"app":"g","state":"old"}', '{"v":2,"app":"other"}', "broken", '{"v":0,"app":"g"}']
    up = {1: lambda r: r.withField("v", F.lit(2)).withField("state", F.concat(r["state"], F.lit("+")))}
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "c string").select(records.read_record(F.col("c"), "g", 2, up)).collect()]
    assert (got[0].record.state, got[0].too_new) == ("s", False) and got[1].too_new and (got[2].record.v, got[2].record.state) == (2, "old+") and got[3:] == [None, None, None]


def test_conditions(spark):
    row = spark.createDataFrame([({"q1": "done"}, {"f": True, "g": False}, 3, "dec", ["q1"], ["q2"])], "quests map<string,string>, flags map<string,boolean>, n int, phase string, impl array<string>, rep array<string>")
    conds = {"quest:q1:done": True, "quest:q1:!done": False, "quest:q9:offered": True, "!flag:f": False, "flag:g": False, "flag:zz": False, "clears>=3": True, "clears>=4": False, "phase:dec": True, "impl:q1": True, "!impl:q2": True, "reportable:q2": True, "nonsense": False}
    got = row.select(*[records.condition(c, *[F.col(x) for x in row.columns]).alias(str(i)) for i, c in enumerate(conds)]).first()
    assert list(got) == list(conds.values())


def test_paths_names_assets(spark):
    paths = {"a/b": True, "../a": False, "a/../b": True, "a/../../b": False, "/a": False, "C:\\x": False, "a\\..\\..\\b": False, "./a": True}
    assert [r[0] for r in spark.createDataFrame([(p,) for p in paths], "c string").select(records.is_safe_path(F.col("c"))).collect()] == list(paths.values())
    files = spark.createDataFrame([("x/a.txt",), ("y/a.md",), ("z/b:c.txt",)], "path string")
    assert {r.path: r.file_name for r in records.unique_names(files).collect()} == {"x/a.txt": "a", "y/a.md": "a_2", "z/b:c.txt": "b_c"}
    runs = spark.createDataFrame([(1, 1, None, "a"), (1, 2, None, "b"), (1, 3, "x", "c"), (1, 4, None, "d")], "k int, o int, style string, text string")
    assert [(r.first, r.style, r.text) for r in records.merged_runs(runs, ["k"], "o", "style", "text").orderBy("first").collect()] == [(1, None, "ab"), (3, "x", "c"), (4, None, "d")]
    sealed = spark.range(1).select(records.seal(F.lit("p").cast("binary"), F.lit("0" * 16).cast("binary"), F.lit("h").cast("binary")).alias("s"))
    back = sealed.select(*[records.unseal(F.col("s"), F.lit("0" * 16).cast("binary"), F.lit(h).cast("binary")) for h in ("h", "x")]).first()
    assert list(back) == [b"p", None]


def test_prompt_drops_slides_from_the_end(spark):
    deck = "".join(f"<section><h2>S{i}: x</h2><ul><li>one {i}</li><li>- two</li></ul></section>" for i in range(9)) + "<section><h2>T</h2><table><tr><th>a</th></tr><tr><td>1</td></tr></table></section>"
    rows = structure.classified(structure.slides(html.elements(spark.createDataFrame([(1, deck)], "page_id int, html string"))))
    titles = spark.createDataFrame([(1, "Deck")], "page_id int, title string")
    full = prompts.prompts(rows, titles).first()
    assert (full.n_slides, full.dropped, full.kinds) == (10, 0, ["bullets", "table"]) and '題名: "S0: x"' in full.prompt and '- "- two"' in full.prompt and "見出し: [a]" in full.prompt
    short = prompts.prompts(rows, titles, 200).first()
    assert 0 < short.n_slides < 9 and short.n_slides + short.dropped == 10 and "S8" not in short.prompt and short.kinds == ["bullets"]
    none = prompts.prompts(rows, titles, 5).first()
    assert (none.n_slides, none.dropped) == (0, 10)


def test_css_text():
    assert theme.blocks("a, b { x: 1 } @media p { c { y: 2 } d{z:3} } e{") == [("a, b ", " x: 1 "), (" c ", " y: 2 "), (" d", "z:3")]
    assert theme.without_comments("a/* b */c/* d").split() == ["a", "c/*", "d"]
    assert theme.substituted("1px var(--a, red) var( --b ) var(--c)", {"--b": "#fff"}) == "1px red #fff "
    assert [theme.hex_of(x) for x in ("#abc", "#A1B2C3", "#abcd", "abc", "rgb(1, 2, 300)", "rgba(1,2,3,0.0)", "rgba(1,2,3,.5)", "rgb(1.5,2,3)", "rgb(1%,2%,3%)", "red")] == ["#AABBCC", "#A1B2C3", None, None, "#0102FF", None, "#010203", None, None, None]


def png(width):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + width.to_bytes(4, "big") + b"\0\0\0\x05"


@pytest.mark.parametrize("src, want", [("img/a.png", "x/img/a.png"), ("../img/a.png", "x/img/a.png"), ("a.png?v=1", "x/img/a.png"), ("other/a.png", "x/img/a.png"), ("b%20c.gif", "b c.gif"), ("http://h/a.png", None), ("//h/a.png", None), ("data:,a.png", None), ("no.png", None), ("", None), ("W.JPG", "win\\W.JPG")])
def test_asset_of(src, want):
    assert html.asset_of(src, ["x/img/a.png", "b c.gif", "win\\W.JPG"]) == want


def test_pictures_that_come_with_a_page(spark):
    page = '<section><h2>T</h2><p>before</p><img src="{}"></section>'
    pages = spark.createDataFrame([(1, page.format("img/wide.png")), (2, page.format("img/small.png")), (3, page.format("http://h/a.png")), (4, page.format("gone.png")), (5, "<section><h2>Only</h2></section>"), (6, ""), (7, page.format("data:,x")), (8, page.format("notes.txt"))], "page_id int, html string")
    assets = spark.createDataFrame([(1, "img/wide.png", png(900)), (2, "img/small.png", png(300)), (2, "img/small.png", png(300)), (4, None, None), (8, "notes.txt", b"text"), (9, "z", b"")], "page_id int, path string, content binary")
    found = html.elements(pages, assets=assets).cache()
    rows = {r.page_id: (r.asset, r.pair_row, r.side) for r in found.where("type = 'image'").collect()}
    assert rows == {1: ("img/wide.png", None, None), 2: ("img/small.png", 1, "right"), 3: (None, 1, "right"), 4: (None, 1, "right"), 7: (None, 1, "right"), 8: ("notes.txt", 1, "right")}
    got = {(r.page_id, r.slide_no, r.code, r.detail) for r in html.warnings(pages, found).collect()}
    assert got == {(3, 1, "REMOTE_IMAGE_SKIPPED", "http://h/a.png"), (4, 1, "IMAGE_NOT_FOUND", "gone.png"), (5, 1, "SLIDE_HAS_NO_CONTENT", "Only"), (6, None, "NO_CONTENT", None)}
    assert {r.asset for r in html.elements(pages).collect()} == {None}


@pytest.mark.parametrize("classes, want", [("card", True), ("my-card big", True), ("CARD_2", True), ("cards", False), ("discard", False), ("", False)])
def test_names_of_classes(classes, want):
    assert html.is_called(classes, html.CARD) is want


def test_image_manifest(spark):
    page = '<section><h2>T</h2><img src="img/a.png" alt="one"><p>x</p></section><section><h2>U</h2><img src="other/a.png?v=2"><img src="http://h/b:c.png"><img src="data:,x" alt="in"></section>'
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    assets = spark.createDataFrame([(1, "x/img/a.png", png(10)), (1, "other/a.png", png(20))], "page_id int, path string, content binary")
    manifest = reports.image_manifest(html.elements(pages, assets=assets)).cache()
    rows = {(r.slide_no, r.filename, r.alt, r.available) for r in manifest.collect()}
    assert rows == {(1, "a.png", "one", True), (2, "a.png", "", True), (2, "b:c.png", "", False), (2, "", "in", True)}
    got = {(r.file_name, r.slide_no) for r in reports.packed_images(manifest).collect()}
    assert {n for n, _ in got if n == "a.png"} and ("a.png", 2) in got and len(got) == 2 and any(n.startswith("image_2_") for n, _ in got)
