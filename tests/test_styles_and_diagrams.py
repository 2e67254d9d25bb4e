import colorsys
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.functions import color
from docloom.operators import diagrams, layers
from docloom.sources import decks, pptx

from test_decks_and_reports import NS, at

# -- colours ---------------------------------------------------------------------------


def plain_color(c, steps):
    """A colour after its steps, by the standard library."""
    unit = lambda v: min(1.0, max(0.0, v))
    rgb = [int(c[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    for op, v in steps:
        if op[:3] in ("lum", "sat", "hue"):
            h, l, s = colorsys.rgb_to_hls(*rgb)  # noqa: E741
            if op[:3] == "hue":
                h = (h * v if op == "hueMod" else h + v / 360) % 1
            elif op[:3] == "lum":
                l = unit(l * v if op == "lumMod" else l + v)  # noqa: E741
            else:
                s = unit(s * v if op == "satMod" else s + v)
            rgb = list(colorsys.hls_to_rgb(h, l, s))
        elif op in ("shade", "tint"):
            lin = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in map(unit, rgb)]
            lin = [unit(x * v + (1 - v if op == "tint" else 0)) for x in lin]
            rgb = [x * 12.92 if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055 for x in lin]
        elif op == "gray":
            rgb = [0.299 * rgb[0] + 0.587 * rgb[1] + 0.114 * rgb[2]] * 3
        elif op == "inv":
            rgb = [1 - x for x in rgb]
    return "#" + "".join(f"{round(unit(x) * 255):02X}" for x in rgb)


def test_colour_steps_equal_the_standard_library(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        c = rng.choice(["#000000", "#FFFFFF", "#808080", *(f"#{rng.randrange(1 << 24):06X}" for _ in range(9))])
        rows.append((c, [(op, rng.choice([0.0, 1.0, 0.4, 0.75, 1.5, 120.0 if op == "hueOff" else 0.2])) for op in rng.choices([*decks.STEPS, "alpha"], k=rng.randrange(4))]))
    table = spark.createDataFrame([(i, c, s) for i, (c, s) in enumerate(rows)], "i int, c string, s array<struct<op:string,value:double>>")
    got = {r.i: r.out for r in table.select("i", color.transformed(F.col("c"), F.col("s")).alias("out")).collect()}
    for i, (c, s) in enumerate(rows):
        want = plain_color(c, s)
        assert all(abs(int(got[i][k : k + 2], 16) - int(want[k : k + 2], 16)) <= 1 for k in (1, 3, 5)), (c, s)
    assert sum(got[i] != plain_color(*r) for i, r in enumerate(rows)) <= 4  # halves that one way of computing sees as a little less


# -- layers ------------------------------------------------------------------------------


def test_first_known(spark):
    rows = spark.createDataFrame([(1, "a", None, 0), (1, "a", "x", 2), (1, "a", "y", 1), (1, "b", None, 0), (2, "a", "q", 3), (2, "a", "p", 3)], "id int, name string, value string, rank int")
    assert sorted(map(tuple, layers.first_known(rows, ["id", "name"]).collect())) == [(1, "a", "y", 1), (2, "a", "p", 3)]


# -- decks with layouts, masters and themes --------------------------------------------------

DGM = 'xmlns:dgm="http://schemas.openxmlformats.org/drawingml/2006/diagram"'
CHART = 'xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"'
THEME = f"""<a:theme {NS}><a:themeElements><a:clrScheme name="t"><a:dk1><a:sysClr val="windowText" lastClr="101010"/></a:dk1><a:lt1><a:srgbClr val="fefefe"/></a:lt1>
<a:accent1><a:srgbClr val="0000ff"/></a:accent1><a:accent2><a:srgbClr val="00FF00"/></a:accent2></a:clrScheme>
<a:fontScheme name="f"><a:majorFont><a:latin typeface="Major"/><a:ea typeface="Kaku"/></a:majorFont><a:minorFont><a:latin typeface="Minor"/><a:ea typeface=""/></a:minorFont></a:fontScheme></a:themeElements></a:theme>"""


def level(n, size=None, bold=None, fill="", face="", bullet=""):
    return f'<a:lvl{n}pPr>{bullet}<a:defRPr{f" sz={chr(34)}{size}{chr(34)}" if size else ""}{f" b={chr(34)}{bold}{chr(34)}" if bold else ""}>{f"<a:solidFill>{fill}</a:solidFill>" if fill else ""}{f"<a:latin typeface={chr(34)}{face}{chr(34)}/>" if face else ""}</a:defRPr></a:lvl{n}pPr>'


def holder(ph, styles="", text="", box="", body="", name="s", paint=""):
    nv = f'<p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr>'
    return f"<p:sp>{nv}<p:spPr>{box}{paint}</p:spPr><p:txBody><a:bodyPr>{body}</a:bodyPr><a:lstStyle>{styles}</a:lstStyle>{text}</p:txBody></p:sp>"


def par(*runs, pr=""):
    return f"<a:p>{pr}" + "".join(f"<a:r><a:rPr{attr}>{inner}</a:rPr><a:t>{t}</a:t></a:r>" for t, attr, inner in runs) + "</a:p>"


def scheme(key, steps=""):
    return f'<a:schemeClr val="{key}">{steps}</a:schemeClr>'


def fill(inner):
    return f"<a:solidFill>{inner}</a:solidFill>"


MASTER = f"""<p:sldMaster {NS}><p:cSld><p:spTree>{holder('<p:ph type="title"/>', level(1, 4000))}{holder('<p:ph type="body" idx="1"/>', level(1, 2800, fill=scheme("tx1")) + level(2, 2400))}</p:spTree></p:cSld>
<p:clrMap bg1="lt1" tx1="dk1" accent1="accent1"/><p:txStyles><p:titleStyle>{level(1, 4400, 1, face="+mj-lt")}</p:titleStyle>
<p:bodyStyle>{level(1, 3200, face="+mn-ea", bullet='<a:buChar char="x"/>')}{level(3, 2000)}</p:bodyStyle><p:otherStyle>{level(1, 1800, fill=scheme("accent1", '<a:lumMod val="50000"/>'))}</p:otherStyle></p:txStyles></p:sldMaster>"""
LAYOUT = f"""<p:sldLayout {NS}><p:cSld><p:spTree>{holder('<p:ph type="body" idx="7"/>', level(1, 1900, 1))}{holder('<p:ph type="body" idx="9"/>', level(1, 1700))}</p:spTree></p:cSld></p:sldLayout>"""
SMART = f"""<dgm:dataModel {DGM} {NS}><dgm:ptLst><dgm:pt modelId="d" type="doc"/><dgm:pt modelId="1"><dgm:t><a:p><a:r><a:t>top</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt modelId="2"><dgm:t><a:p><a:r><a:t>under</a:t></a:r></a:p></dgm:t></dgm:pt>
<dgm:pt modelId="3"><dgm:t><a:p><a:r><a:t>deep</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt modelId="p" type="pres"><dgm:t><a:p><a:r><a:t>no</a:t></a:r></a:p></dgm:t></dgm:pt><dgm:pt modelId="4"><dgm:t><a:p><a:r><a:t>loose</a:t></a:r></a:p></dgm:t></dgm:pt></dgm:ptLst>
<dgm:cxnLst><dgm:cxn srcId="d" destId="1" srcOrd="0"/><dgm:cxn srcId="1" destId="2" srcOrd="0"/><dgm:cxn srcId="2" destId="3" srcOrd="0"/><dgm:cxn srcId="3" destId="1" srcOrd="0"/><dgm:cxn srcId="p" destId="4" type="presOf"/></dgm:cxnLst></dgm:dataModel>"""
FRAME = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="4" name="{name}"/><p:nvPr/></p:nvGraphicFramePr><a:graphic><a:graphicData>{inner}</a:graphicData></a:graphic></p:graphicFrame>'


def full_deck(*slides, override="", default=""):
    """Slides on one layout, master and theme."""
    b = io.BytesIO()
    rels = lambda *r: '<R xmlns="x">' + "".join(f'<Relationship Id="{i}" Type="a/{k}" Target="{t}"/>' for i, k, t in r) + "</R>"
    with zipfile.ZipFile(b, "w") as z:
        ids = "".join(f'<p:sldId id="{i}" r:id="r{i}"/>' for i in range(len(slides)))
        z.writestr("ppt/presentation.xml", f'<p:presentation {NS}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="{960 * 12700}" cy="{540 * 12700}"/><p:defaultTextStyle>{default}</p:defaultTextStyle></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(*[(f"r{i}", "slide", f"slides/s{i}.xml") for i in range(len(slides))]))
        for i, s in enumerate(slides):
            over = f"<p:clrMapOvr><a:overrideClrMapping {override}/></p:clrMapOvr>" if override and i else ""
            z.writestr(f"ppt/slides/s{i}.xml", f"<p:sld {NS} {DGM} {CHART}><p:cSld><p:spTree>{s}</p:spTree></p:cSld>{over}</p:sld>")
            z.writestr(f"ppt/slides/_rels/s{i}.xml.rels", rels(("l", "slideLayout", "../slideLayouts/l.xml"), ("dm", "diagramData", "../diagrams/d.xml"), ("ch", "chart", "../charts/c.xml"), ("im", "image", "../media/a.png")))
        z.writestr("ppt/slideLayouts/l.xml", LAYOUT)
        z.writestr("ppt/slideLayouts/_rels/l.xml.rels", rels(("m", "slideMaster", "../slideMasters/m.xml")))
        z.writestr("ppt/slideMasters/m.xml", MASTER)
        z.writestr("ppt/slideMasters/_rels/m.xml.rels", rels(("t", "theme", "../theme/t.xml")))
        z.writestr("ppt/theme/t.xml", THEME)
        z.writestr("ppt/diagrams/d.xml", SMART)
        z.writestr("ppt/charts/c.xml", f"<c:chart {CHART} {NS}><c:title><a:t>Sales</a:t></c:title></c:chart>")
        z.writestr("ppt/media/a.png", b"p")
    return b.getvalue()


TITLE = holder('<p:ph type="ctrTitle"/>', text=par(("T", "", "")))
BODY = holder('<p:ph type="body" idx="9"/>', text=par(("one", "", ""), ("own", ' sz="900" b="0"', fill('<a:srgbClr val="abcdef"/>') + '<a:ea typeface="+mj-ea"/>')) + par(("deep", "", ""), pr='<a:pPr lvl="1" algn="ctr"/>') + par(("third", "", ""), pr='<a:pPr lvl="2"><a:buNone/></a:pPr>'))
BY_KIND = holder('<p:ph type="body" idx="4"/>', text=par(("kind", "", "")), body='<a:normAutofit fontScale="50000"/>')
BOX = holder("", text=par(("box", "", ""), ("red", "", fill('<a:scrgbClr r="100000" g="0" b="0"/>')), ("odd", "", fill(scheme("phClr")))))
LISTED = holder("", level(1, 1100), text=par(("list", "", "")) + par(("para", "", ""), pr='<a:pPr><a:buAutoNum type="x"/><a:defRPr sz="1200"/></a:pPr>'))


@pytest.fixture(scope="module")
def found(spark):
    raw = full_deck(TITLE + BODY + BY_KIND + BOX + LISTED, BODY + BOX, override='tx1="accent2" accent1="lt1"', default=level(1, 1000, 1, face="Last"))
    table = spark.createDataFrame([(1, raw), (2, b"broken"), (3, None), (4, full_deck())], "page_id int, content binary")
    return table, decks.facts(table).cache()


def test_runs_inherit_by_layers(found):
    rows = {(r.slide_no, r.text): r for r in decks.styled_runs(found[1]).collect()}
    style = lambda n, t: (rows[n, t].size_pt, rows[n, t].bold, rows[n, t].color, rows[n, t].font, rows[n, t].bullet, rows[n, t].inherited)
    assert style(1, "T") == (40.0, True, None, "Major", None, ["size_pt", "bold", "font"])  # master's title box, then its title style
    assert style(1, "one") == (17.0, True, "#101010", "Minor", "bullet", ["size_pt", "bold", "color", "font"])  # layout by index, master's box, body style
    assert style(1, "own") == (9.0, False, "#ABCDEF", "Kaku", "bullet", [])
    assert style(1, "deep")[:2] == (24.0, None) and rows[1, "deep"].align == "center" and rows[1, "deep"].font == "Minor"  # level 2: master's box; the style's first level
    assert style(1, "third")[0] == 20.0 and rows[1, "third"].bullet is None
    assert style(1, "kind")[0] == 9.5 and rows[1, "kind"].bold is True  # layout by kind: its first body box, half as large
    assert style(1, "box") == (18.0, True, "#000080", "Last", None, ["size_pt", "bold", "color", "font"])  # other style, darker accent; the deck's default
    assert rows[1, "red"].color == "#FF0000" and rows[1, "odd"].color == "#000080"
    assert style(1, "list")[0] == 11.0 and style(1, "para")[0] == 12.0 and rows[1, "para"].bullet == "number"
    #: the second slide maps text to accent2 and accent1 to lt1
    assert rows[2, "one"].color == "#00FF00" and rows[2, "box"].color == "#7F7F7F"


def test_themes_and_unresolved_slots(found):
    themes = {(r.page_id, r.slide_no): r for r in decks.slide_themes(found[1]).collect()}
    assert themes[1, 1].mapping["tx1"] == "dk1" and themes[1, 2].mapping == {"bg1": "lt1", "tx1": "accent2", "accent1": "lt1"}
    assert themes[1, 1].colors == {"dk1": "#101010", "lt1": "#FEFEFE", "accent1": "#0000FF", "accent2": "#00FF00"} and themes[1, 1].fonts == {"major_latin": "Major", "major_ea": "Kaku", "minor_latin": "Minor"}
    got = {tuple(r) for r in decks.warnings(found[1]).collect()}
    assert {(1, n, None, "THEME_COLOR_UNRESOLVED", "phClr") for n in (1, 2)} <= got
    assert {(p, c) for p, _, _, c, _ in got} == {(1, "THEME_COLOR_UNRESOLVED"), (2, "DECK_UNREADABLE"), (3, "DECK_UNREADABLE")}


def test_elements_take_inherited_sizes(found):
    rows = [r for r in decks.styled_elements(*found).orderBy("slide_no", "el_no").collect()]
    assert [(r.slide_no, r.role, r.size_pt) for r in rows] == [(1, "title", 40.0), (1, "body", 24.0), (1, "body", 9.5), (1, "body", 18.0), (1, "body", 12.0), (2, "body", 24.0), (2, "body", 18.0)]
    assert rows[3].color == "#000080" and rows[3].bold is True and rows[1].font == "Minor" and rows[0].slide_title == "T" and rows[0].layout == rows[5].layout == "two_column"


def test_inherited_size_makes_a_title(spark):
    raw = full_deck(holder("", text=par(("small", "", "")), box=at(0, 5, 9, 9)) + holder("", text=par(("Big", "", "")), box=at(0, 9, 9, 9), styles=level(1, 3000)), TITLE)
    table = spark.createDataFrame([(1, raw)], "page_id int, content binary")
    rows = {(r.slide_no, r.el_no): (r.role, r.layout, r.slide_title) for r in decks.styled_elements(table, decks.facts(table)).collect()}
    assert rows == {(1, 1): ("body", "title", "Big"), (1, 2): ("title", "title", "Big"), (2, 1): ("title", "title_body", "T")}


def test_smartart_charts_and_warnings(spark):
    frames = FRAME.format(name="s", inner='<dgm:relIds r:dm="dm"/>') + FRAME.format(name="c", inner='<c:chart r:id="ch"/>') + FRAME.format(name="o", inner="<a:x/>") + FRAME.format(name="e", inner='<dgm:relIds r:dm="none"/>')
    pictures = '<p:pic><p:nvPicPr><p:cNvPr id="3" name="i"/><p:nvPr/></p:nvPicPr><p:blipFill><a:blip r:embed="{}"/>{}</p:blipFill></p:pic>'
    odd = holder("", text=par(("star", "", "")), paint=f'<a:prstGeom prst="star5"/>{fill(scheme("lt1"))}', box=at(0, 0, 9, 9).replace("<a:xfrm", '<a:xfrm rot="5400000"'))
    raw = full_deck(frames + pictures.format("im", '<a:srcRect l="5000"/>') + pictures.format("gone", "") + pictures.format("im", '<a:srcRect l="50"/>') + odd + holder("", text=par(("x", "", "")), name="footer3"))
    table = spark.createDataFrame([(1, raw)], "page_id int, content binary")
    found = decks.facts(table).cache()
    codes = {r.el_no: (r.code, r.detail) for r in decks.warnings(found).collect()}
    assert codes == {1: ("SMARTART_TEXT_ONLY", "s"), 2: ("CHART_UNSUPPORTED", "Sales"), 3: ("ELEMENT_UNSUPPORTED", "o"), 4: ("SMARTART_UNSUPPORTED", "e"), 5: ("IMAGE_CROP_IGNORED", "i"), 6: ("IMAGE_READ_FAILED", "i"), 8: ("SHAPE_APPROXIMATED", "s")}
    assert [(r.level, r.text) for r in decks.smartart_levels(found).orderBy("nth").collect()] == [(0, "top"), (1, "under"), (2, "deep"), (0, "loose")]
    rows = {r.el_no: r for r in pptx.elements(table).collect()}
    assert len(rows) == 8 and rows[1].lines == ["top", "under", "deep", "loose"] and rows[1].role == "body" and rows[8].turned == 90.0 and rows[8].shape == "rect" and rows[6].type == "unsupported"


# -- diagrams by name ----------------------------------------------------------------------


def plain_items(kind, boxes):
    """(title, value, text) of boxes (x, y, el_no, lines), by looking for each box's first free partner in its column."""
    order = sorted((b for b in boxes if b[3]), key=lambda b: (b[1] // 20, b[0], b[2]))
    if kind not in ("kpi", "timeline", "compare"):
        return [(b[3][0], None, " ".join(b[3][1:]) or None) for b in order]
    used, out = set(), []
    for i, (x, _, _, lines) in enumerate(order):
        if i in used:
            continue
        mate = next((j for j in range(i + 1, len(order)) if j not in used and abs(order[j][0] - x) < 4), None)
        used |= {i, mate}
        text = order[mate][3][0] if mate is not None else None
        out.append((text or lines[0], lines[0], text) if kind == "kpi" else (lines[0], None, text))
    return out[:2] if kind == "compare" else out


def test_named_diagrams(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for page in range(24):
        kind, boxes = ["kpi", "timeline", "compare", "flow"][page % 4], []
        for e in range(1, rng.randrange(2, 12)):
            lines = [f"t{e}", "more", "end"][: rng.randrange(0, 4)]
            x, y = rng.randrange(3) * 50.0 + rng.choice([0, 0.5, 1]), rng.randrange(8) * 11.0
            boxes.append((x, y, e, lines))
            rows.append((page, 1, e, f"diagram:{kind}:d1:{e}", "shape", [*lines, " "], x, y, 30.0, 10.0))
        rows += [(page, 1, 0, "title", "text", ["T"], 0.0, 0.0, 1.0, 1.0), (page, 1, 40, "diagram:kpi:short", "text", ["x"], 0.0, 0.0, 1.0, 1.0)]
        want[page] = plain_items(kind, boxes), boxes
    table = spark.createDataFrame(rows, "page_id int, slide_no int, el_no int, name string, type string, lines array<string>, x double, y double, w double, h double")
    got = {}
    for r in diagrams.regrouped(table).collect():
        got.setdefault(r.page_id, []).append(r)
    for page, (told, boxes) in want.items():
        whole = [r for r in got[page] if r.type == "diagram"]
        rest = sorted(r.el_no for r in got[page] if r.type != "diagram")
        if not told:
            assert not whole and rest == [0, *(b[2] for b in boxes), 40]
            continue
        assert rest == [0, 40] and [tuple(i) for i in whole[0]["items"]] == told
        assert (whole[0].x, whole[0].y, whole[0].w, whole[0].h) == (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[0] for b in boxes) + 30 - min(b[0] for b in boxes), max(b[1] for b in boxes) + 10 - min(b[1] for b in boxes))
    assert diagrams.regrouped(table.where("page_id < 0")).collect() == []


# -- diagrams by place ----------------------------------------------------------------------


@pytest.mark.parametrize("gap", [0.0, 7.5])
def test_touching_equals_all_pairs(spark, gap):
    rng = random.Random(int(gap) + 1)
    boxes = []
    for i in range(260):
        w, h = (rng.choice([0, 1, 5, 16, 17, 300, 2000]) * rng.random() for _ in range(2))
        boxes.append((i % 3 if i % 7 else None, i, rng.uniform(-900, 900), rng.uniform(-900, 900), w, h))
    boxes += [(0, 300, 10.0, 10.0, 5.0, 5.0), (0, 301, 10.0, 10.0, 5.0, 5.0), (0, 302, 15.0 + gap, 10.0, 5.0, 5.0), (0, 303, None, 1.0, 1.0, 1.0)]
    near = lambda a, b: a[2] - b[2] - b[4] <= gap and b[2] - a[2] - a[4] <= gap and a[3] - b[3] - b[5] <= gap and b[3] - a[3] - a[5] <= gap
    want = sorted((a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and a[0] == b[0] and a[2] is not None and b[2] is not None and near(a, b))
    table = spark.createDataFrame(boxes, "slide int, node long, x double, y double, w double, h double").repartition(4)
    assert sorted(map(tuple, diagrams.touching(table, ["slide"], gap).collect())) == want and len(want) > 100
    root = {b[1]: b[1] for b in boxes}
    for _ in boxes:
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.grp for r in diagrams.groups_of_boxes(table, ["slide"], gap).collect()}
    assert got == root


def test_drawn(spark):
    paint = f'<a:prstGeom prst="rect"/>{fill(scheme("lt1"))}'
    shapes = "".join(holder("", text=par((t, "", "")), box=at(x, y, 50, 20), paint=paint, name=n) for t, x, y, n in [("a", 0, 100, "s"), ("b", 60, 100, "s"), ("c", 300, 100, "s"), ("d", 300, 105, "diagram:flow:z:1"), ("e", 300, 128, "s")])
    table = spark.createDataFrame([(1, full_deck(shapes, shapes))], "page_id int, content binary")
    got = sorted((r.slide_no, r.el_no, r.members, r.x, r.y, r.w, r.h) for r in diagrams.drawn(pptx.elements(table)).collect())
    assert got == [(n, e, m, x, 100.0, w, h) for n in (1, 2) for e, m, x, w, h in [(1, [1, 2], 0.0, 110.0, 20.0), (3, [3, 5], 300.0, 50.0, 48.0)]]
