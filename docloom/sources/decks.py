"""Presentations as tables: theme slots, colour maps, layered text properties, runs, SmartArt and warnings.

One pass over a deck gives its facts; what a run looks like is then decided by
joins over them: properties by the first layer that knows one (paragraph,
shape, layout, master, master's text styles, the deck's default), colours by
the slide's map and the master's theme.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import color
from ..operators.layers import first_known
from ..plans.staging import staged
from . import pptx
from .readers import A, P, _relations, _xml

#: The tables of facts, by name, and their columns; every one also has the deck's id.
FACTS = {
    "slides": "slide_no int, layout string, master string, height double",
    "slots": "master string, kind string, slot string, value string",
    "maps": "scope string, name string, slot string",
    "colors": "color_id int, tag string, value string, r double, g double, b double, steps array<struct<op:string,value:double>>",
    "placeholders": "part string, nth int, idx string, type string, holder string",
    "properties": "holder string, level int, name string, value string, color_id int",
    "shapes": "slide_no int, el_no int, holder string, ph_idx string, ph_type string, scale double",
    "runs": "slide_no int, el_no int, par_no int, run_no int, text string, level int, align string, holder string, size_pt double, bold boolean, italic boolean, underline boolean, font string, color_id int",
    "points": "slide_no int, el_no int, nth int, point string, type string, text string",
    "connections": "slide_no int, el_no int, parent string, child string, place int",
    "warnings": "slide_no int, el_no int, code string, detail string",
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<struct<op:string,value:double>>": pa.list_(pa.struct([("op", pa.string()), ("value", pa.float64())]))}
#: The level of a paragraph's own properties.
OWN = -1
LEVELS = 9
# Titles among placeholders, alignments, colour steps with what stands for an unreadable value.
TITLES, BODIES = ("title", "ctrTitle"), ("body", "obj")
ALIGNMENTS = {"l": "left", "ctr": "center", "r": "right", "just": "justify"}
STEPS = {"lumMod": 1.0, "lumOff": 0.0, "satMod": 1.0, "satOff": 0.0, "hueMod": 1.0, "hueOff": 0.0, "shade": 1.0, "tint": 1.0, "gray": 0.0, "inv": 0.0}
UNREADABLE, NO_SLOT = "DECK_UNREADABLE", "THEME_COLOR_UNRESOLVED"


# -- one deck ------------------------------------------------------------------------


def _number(text: str | None, by: float, default: float | None) -> float | None:
    try:
        return int(text) / by
    except (TypeError, ValueError):
        return default


def _name(x: ET.Element) -> str:
    return x.tag.rpartition("}")[2]


class _Facts:
    def __init__(self, raw: bytes):
        self.deck = pptx._Deck(raw)
        self.z = self.deck.z
        self.rows: dict[str, list[dict]] = {k: [] for k in FACTS}
        self.known: set[str] = set()

    def add(self, table: str, *values) -> None:
        self.rows[table].append(dict(zip((c.split()[0] for c in FACTS[table].split(", ")), values)))

    def color(self, parent: ET.Element | None) -> int | None:
        """The id of the colour that fills; None without one."""
        fill = parent.find(A + "solidFill") if parent is not None else None
        if fill is None or not len(fill):
            return None
        x = fill[0]
        steps = [{"op": _name(c), "value": _number(c.get("val"), 60_000 if _name(c) == "hueOff" else 100_000, STEPS[_name(c)])} for c in x if _name(c) in STEPS]
        value = x.get("lastClr") if _name(x) == "sysClr" else x.get("val")
        self.add("colors", len(self.rows["colors"]), _name(x), value, *(_number(x.get(c, "0"), 100_000, None) for c in "rgb"), steps)
        return len(self.rows["colors"]) - 1

    def properties(self, holder: str, level: int, pr: ET.Element | None) -> None:
        if pr is None:
            return
        kinds = [("none", ("buNone",)), ("number", ("buAutoNum",)), ("bullet", ("buChar", "buBlip"))]
        values = {"bullet": next((k for k, tags in kinds if any(pr.find(A + t) is not None for t in tags)), None)}
        run = pr.find(A + "defRPr")
        if run is not None:
            size, bold = _number(run.get("sz"), 100, None), run.get("b")
            values |= {"size_pt": None if size is None else str(size), "bold": None if bold is None else str(bold in ("1", "true")).lower(), "font": _face(run)}
            if (filled := self.color(run)) is not None:
                self.add("properties", holder, level, "color", None, filled)
        for name, value in values.items():
            if value is not None:
                self.add("properties", holder, level, name, value, None)

    def levels(self, holder: str, styles: ET.Element | None) -> None:
        for n in range(LEVELS) if styles is not None else ():
            self.properties(holder, n, styles.find(f"{A}lvl{n + 1}pPr"))

    def scope(self, scope: str, mapping: ET.Element | None) -> None:
        for name, slot in (mapping.attrib if mapping is not None else {}).items():
            self.add("maps", scope, name, slot)

    def part(self, part: str, kind: str) -> str | None:
        """Read a slide's layout or master once; the part that it rests on."""
        relations = _relations(self.z, part)
        target = next((t for k, t in relations.values() if k == kind), None)
        if part in self.known:
            return target
        self.known.add(part)
        tree = _xml(self.z, part)
        for n, s in enumerate(tree.iter(P + "sp")):
            ph = s.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            if ph is not None and s.find(P + "txBody") is not None:
                self.add("placeholders", part, n, ph.get("idx", "0"), ph.get("type", "obj"), f"{part}#{n}")
                self.levels(f"{part}#{n}", s.find(f"{P}txBody/{A}lstStyle"))
        self.scope(part, tree.find(P + "clrMap") if kind == "theme" else tree.find(f"{P}clrMapOvr/{A}overrideClrMapping"))
        if kind == "theme":
            for style in ("title", "body", "other"):
                self.levels(f"{part}#{style}", tree.find(f"{P}txStyles/{P}{style}Style"))
            if target:
                self.theme(part, _xml(self.z, target))
        return target

    def theme(self, master: str, tree: ET.Element) -> None:
        scheme, fonts = tree.find(f".//{A}clrScheme"), tree.find(f".//{A}fontScheme")
        for slot in scheme if scheme is not None else ():
            value = (slot[0].get("val") if _name(slot[0]) == "srgbClr" else slot[0].get("lastClr")) if len(slot) else None
            if value and len(value) == 6:
                self.add("slots", master, "color", _name(slot), "#" + value.upper())
        for kind in ("major", "minor") if fonts is not None else ():
            for script in ("latin", "ea", "cs"):
                face = fonts.find(f"{A}{kind}Font/{A}{script}")
                if face is not None and face.get("typeface"):
                    self.add("slots", master, "font", f"{kind}_{script}", face.get("typeface"))

    def text(self, slide: int, el: int, s: ET.Element) -> None:
        body, ph, holder = s.find(P + "txBody"), s.find(f"{P}nvSpPr/{P}nvPr/{P}ph"), f"slide {slide} element {el}"
        fit = body.find(f"{A}bodyPr/{A}normAutofit")
        scale = _number(fit.get("fontScale"), 100_000, 1.0) if fit is not None else 1.0
        self.add("shapes", slide, el, holder, *((ph.get("idx", "0"), ph.get("type", "obj")) if ph is not None else (None, None)), scale)
        self.levels(holder, body.find(A + "lstStyle"))
        for n, p in enumerate(body.findall(A + "p")):
            pr, own = p.find(A + "pPr"), f"{holder} paragraph {n}"
            self.properties(own, OWN, pr)
            level = int(pr.get("lvl", 0)) if pr is not None else 0
            for k, r in enumerate(p.findall(A + "r")):
                rp = r.find(A + "rPr")
                get = rp.get if rp is not None else lambda _: None
                flag = lambda v, off: None if v is None else v not in off
                self.add(
                    "runs", slide, el, n, k, "".join(t.text or "" for t in r.findall(A + "t")), level, ALIGNMENTS.get(pr.get("algn", "") if pr is not None else ""), own,
                    _number(get("sz"), 100, None), flag(get("b"), ("0", "false")), flag(get("i"), ("0", "false")), flag(get("u"), ("none",)), _face(rp), self.color(rp),
                )

    def all(self) -> dict[str, list[dict]]:
        deck = _xml(self.z, "ppt/presentation.xml")
        self.levels("deck", deck.find(P + "defaultTextStyle"))
        for n, slide in enumerate(self.deck.slides(), 1):
            part = slide["part"]
            layout = next((t for k, t in _relations(self.z, part).values() if k == "slideLayout"), None)
            master = self.part(layout, "slideMaster") if layout else None
            if master:
                self.part(master, "theme")
            self.scope(f"slide {n}", _xml(self.z, part).find(f"{P}clrMapOvr/{A}overrideClrMapping"))
            self.add("slides", n, layout, master, slide["height"])
            for e, el in enumerate(slide["elements"], 1):
                if el["xml"].tag == P + "sp" and el["xml"].find(P + "txBody") is not None:
                    self.text(n, e, el["xml"])
                for k, (point, kind, text) in enumerate(el["points"][0] if el["points"] else ()):
                    self.add("points", n, e, k, point, kind, text)
                for edge in el["points"][1] if el["points"] else ():
                    self.add("connections", n, e, *edge)
                if el["warn"]:
                    self.add("warnings", n, e, el["warn"], el["alt"] or el["name"])
        return self.rows


def _face(run: ET.Element | None) -> str | None:
    """The typeface of a run: the East Asian one first."""
    faces = [run.find(A + t) for t in ("ea", "latin")] if run is not None else []
    return next((f.get("typeface") for f in faces if f is not None and f.get("typeface")), None)


def facts_of(raw: bytes) -> dict[str, list[dict]]:
    try:
        return _Facts(raw).all()
    except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError) as e:
        return {k: [] for k in FACTS} | {"warnings": [{"slide_no": None, "el_no": None, "code": UNREADABLE, "detail": str(e)}]}


# -- tables of facts -----------------------------------------------------------------


def facts(decks: DataFrame, id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """One row per deck: its id, and an array for each table of FACTS.  A deck that can't be read has one warning and nothing else."""
    columns = {t: [c.split(" ", 1) for c in spec.split(", ")] for t, spec in FACTS.items()}
    arrow = {t: pa.list_(pa.struct([(c, _ARROW[k]) for c, k in cs])) for t, cs in columns.items()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a deck at a time, as one can be large
                found = facts_of(batch.column(1)[i].as_py() or b"")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([found[t]], arrow[t]) for t in FACTS)], names=[id_col, *FACTS])

    kind = dict(decks.dtypes)[id_col]
    schema = f"{id_col} {kind}, " + ", ".join(f"{t} array<struct<{','.join(f'{c}:{k}' for c, k in cs)}>>" for t, cs in columns.items())
    return decks.select(F.col(id_col), F.col(content_col).alias("content")).mapInArrow(run, schema)


def rows_of(found: DataFrame, name: str, id_col: str = "page_id") -> DataFrame:
    """One of the tables of FACTS, with the deck's id."""
    return found.select(id_col, F.explode(name).alias("x")).select(id_col, "x.*")


# -- themes and colours ---------------------------------------------------------------


def slide_themes(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, master, mapping, colors, fonts): the slide's map of colour names, over the layout's and the master's, and the master's slots."""
    slides = rows_of(found, "slides", id_col)
    scopes = F.array(*[F.struct(F.lit(i).alias("rank"), c.alias("scope")) for i, c in enumerate((F.concat(F.lit("slide "), F.col("slide_no").cast("string")), F.col("layout"), F.col("master")))])
    layered = slides.select(id_col, "slide_no", F.explode(scopes).alias("x")).select(id_col, "slide_no", "x.*").join(rows_of(found, "maps", id_col), [id_col, "scope"])
    mapping = first_known(layered, [id_col, "slide_no", "name"], "slot").groupBy(id_col, "slide_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "slot"))).alias("mapping"))
    slots = rows_of(found, "slots", id_col).groupBy(id_col, "master", "kind", "slot").agg(F.first("value").alias("value"))
    of = lambda kind, name: slots.where(F.col("kind") == kind).groupBy(id_col, "master").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias(name))
    return slides.join(mapping, [id_col, "slide_no"], "left").join(of("color", "colors"), [id_col, "master"], "left").join(of("font", "fonts"), [id_col, "master"], "left").select(id_col, "slide_no", "master", "mapping", "colors", "fonts")


def scheme_slot(key: Column, mapping: Column, colors: Column) -> Column:
    """``#RRGGBB`` of a scheme colour: by the map's slot, else by its own name."""
    return F.coalesce(F.try_element_at(colors, F.coalesce(F.try_element_at(mapping, key), key)), F.try_element_at(colors, key))


def base_color(tag: Column, value: Column, parts: list[Column], slot: Column) -> Column:
    """``#RRGGBB`` of a colour element before its steps; null if it can't be told."""
    six = F.when(F.length(value) == 6, F.concat(F.lit("#"), F.upper(value)))
    share = F.concat(F.lit("#"), *[F.lpad(F.hex(F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)) * 255).cast("long")), 2, "0") for p in parts])
    return F.when(tag.isin("srgbClr", "sysClr"), six).when(tag == "scrgbClr", share).when(tag == "schemeClr", slot)


def resolved(uses: DataFrame, found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, color_id, color, slot) of colour elements used on slides; ``slot`` names a scheme colour that no theme holds."""
    known = uses.distinct().join(rows_of(found, "colors", id_col), [id_col, "color_id"]).join(slide_themes(found, id_col), [id_col, "slide_no"], "left")
    base = base_color(F.col("tag"), F.col("value"), [F.col(c) for c in "rgb"], scheme_slot(F.col("value"), F.col("mapping"), F.col("colors")))
    lost = F.when((F.col("tag") == "schemeClr") & F.col("base").isNull(), F.col("value"))
    return known.withColumn("base", base).select(id_col, "slide_no", "color_id", color.transformed(F.col("base"), F.col("steps")).alias("color"), lost.alias("slot"))


def theme_font(face: Column, fonts: Column) -> Column:
    """A typeface; ``+mj-ea`` and the like by the theme's slots, latin where the script has none."""
    kind = F.when(F.substring(face, 2, 2) == "mj", "major").otherwise("minor")
    code = F.substring(face, 5, 2)
    script = F.when(code == "ea", "ea").when(code == "cs", "cs").otherwise("latin")
    slot = lambda s: F.try_element_at(fonts, F.concat_ws("_", kind, s))
    return F.when(face.startswith("+") & fonts.isNotNull(), F.coalesce(slot(script), slot(F.lit("latin")))).otherwise(face)


# -- inherited styles ------------------------------------------------------------------


def layer_chain(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, el_no, par_no, rank, holder, level): where a paragraph's properties are looked for, in order.

    Its own properties, the shape's list style, the layout's placeholder (by
    index, else by kind), the master's (titles, else body), the master's text
    style at the level and at the first, the deck's default.
    """
    keys = [id_col, "slide_no", "el_no"]
    shapes = rows_of(found, "shapes", id_col).join(rows_of(found, "slides", id_col), [id_col, "slide_no"])
    places = rows_of(found, "placeholders", id_col)
    style = F.when(F.col("ph_type").isNull(), "other").when(F.col("ph_type").isin(*TITLES), "title").otherwise("body")
    layout = shapes.join(places.withColumnRenamed("part", "layout").select(id_col, "layout", "nth", "idx", "type", F.col("holder").alias("in_layout")), [id_col, "layout"]).where((F.col("idx") == F.col("ph_idx")) | (F.col("type") == F.col("ph_type")))
    layout = layout.groupBy(*keys).agg(F.min_by("in_layout", F.struct(F.col("idx") != F.col("ph_idx"), "nth")).alias("in_layout"))
    master = shapes.where("ph_type is not null").withColumn("type", F.when(style == "title", "title").otherwise("body")).join(places.withColumnRenamed("part", "master").select(id_col, "master", "nth", "type", F.col("holder").alias("in_master")), [id_col, "master", "type"])
    master = master.groupBy(*keys).agg(F.min_by("in_master", "nth").alias("in_master"))
    shapes = shapes.join(layout, keys, "left").join(master, keys, "left").withColumn("style", F.concat_ws("#", "master", style))
    paragraphs = rows_of(found, "runs", id_col).select(*keys, "par_no", "level", F.col("holder").alias("own")).distinct().join(shapes, keys)
    level, first = F.col("level"), F.when(F.col("level") > 0, F.col("style"))
    order = [(F.col("own"), F.lit(OWN)), (F.col("holder"), level), (F.col("in_layout"), level), (F.col("in_master"), level), (F.col("style"), level), (first, F.lit(0)), (F.lit("deck"), level)]
    return paragraphs.select(*keys, "par_no", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), h.alias("holder"), n.alias("level")) for i, (h, n) in enumerate(order)])).alias("x")).select(*keys, "par_no", "x.*").where("holder is not null")


def styled_runs(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, el_no, par_no, run_no, text, level, align, bullet, size_pt, bold, italic, underline, color, font, inherited) of every run.

    What a run doesn't say itself comes from the first layer that says it, and
    ``inherited`` names it; sizes are scaled as the shape's autofit wants.
    ``found`` should be staged, as it is read several times.
    """
    keys = [id_col, "slide_no", "el_no", "par_no"]
    runs, themes = rows_of(found, "runs", id_col), slide_themes(found, id_col)
    layered = staged(layer_chain(found, id_col).join(rows_of(found, "properties", id_col), [id_col, "holder", "level"]).select(*keys, "rank", "name", "value", "color_id"))
    uses = layered.union(runs.select(*keys, F.lit(0), F.lit("color"), F.lit(None), "color_id")).where("color_id is not null").select(id_col, "slide_no", "color_id")
    colors = staged(resolved(uses, found, id_col).select(id_col, "slide_no", "color_id", "color"))
    values = layered.join(colors, [id_col, "slide_no", "color_id"], "left").withColumn("value", F.coalesce("color", "value"))
    known = first_known(values, [*keys, "name"])
    each = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(f"by_{n}")
    names = ("size_pt", "bold", "color", "font")
    wide = known.groupBy(*keys).agg(*[each(n) for n in (*names, "bullet")])
    shapes = rows_of(found, "shapes", id_col).select(id_col, "slide_no", "el_no", "ph_type", "scale")
    rows = runs.join(wide, keys, "left").join(shapes, keys[:3]).join(colors, [id_col, "slide_no", "color_id"], "left").join(themes.select(id_col, "slide_no", "fonts"), keys[:2], "left")
    own = {"size_pt": F.col("size_pt"), "bold": F.col("bold"), "color": F.col("color"), "font": theme_font(F.col("font"), F.col("fonts"))}
    other = {"size_pt": F.col("by_size_pt").cast("double"), "bold": F.col("by_bold").cast("boolean"), "color": F.col("by_color"), "font": theme_font(F.col("by_font"), F.col("fonts"))}
    both = {n: F.coalesce(own[n], other[n]) for n in names}
    size = F.when(F.col("scale") == 1, both["size_pt"]).otherwise(F.bround(both["size_pt"] * F.col("scale"), 1))
    inherited = F.filter(F.array(*[F.when(own[n].isNull() & other[n].isNotNull(), n) for n in names]), lambda n: n.isNotNull())
    bullet = F.when(F.col("by_bullet") == "none", None).otherwise(F.coalesce("by_bullet", F.when(F.col("ph_type").isin(*BODIES), "bullet")))
    return rows.select(*keys, "run_no", "text", "level", "align", bullet.alias("bullet"), size.alias("size_pt"), both["bold"].alias("bold"), "italic", "underline", both["color"].alias("color"), both["font"].alias("font"), inherited.alias("inherited"))


def styled_elements(decks: DataFrame, found: DataFrame, id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """The element table with inherited styles: size_pt is the largest of an element's runs, color, font and bold those of the first run of that size.

    Titles and layouts are told anew, as an inherited size can make a title.
    """
    keys = [id_col, "slide_no", "el_no"]
    best = F.min_by(F.struct("size_pt", "color", "font", "bold"), F.struct(-F.coalesce("size_pt", F.lit(0.0)), "par_no", "run_no"))
    style = styled_runs(found, id_col).where(F.trim("text") != "").groupBy(*keys).agg(best.alias("style"))
    rows = pptx.elements(decks, id_col, content_col).join(style, keys, "left").withColumn("size_pt", F.coalesce("style.size_pt", "size_pt"))
    rows = rows.select("*", F.col("style.color").alias("color"), F.col("style.font").alias("font"), F.col("style.bold").alias("bold")).drop("style")
    return titled(rows.join(rows_of(found, "slides", id_col).select(id_col, "slide_no", "height"), keys[:2]), id_col)


def titled(rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Elements with role, slide_title and layout told from sizes: :func:`pptx.infer_title` and :func:`pptx.layout_of` over a table of slides."""
    slide = W.partitionBy(id_col, "slide_no")
    chars = F.length(F.array_join("lines", ""))
    small = (F.col("type") == "text") & (F.col("y") <= F.col("height") * pptx.TITLE_SHARE) & chars.between(1, pptx.TITLE_CHARS) & (F.size("lines") <= 2) & (F.col("size_pt") >= pptx.TITLE_POINTS)
    best = F.min(F.when(small, F.struct(-F.col("size_pt"), "el_no"))).over(slide)["el_no"]
    no_title = ~F.coalesce(F.max(F.col("role") == "title").over(slide), F.lit(False))
    rows = rows.withColumn("role", F.when(no_title & (F.col("el_no") == best), "title").otherwise(F.col("role")))
    n = lambda c: F.count(F.when(c, 1)).over(slide)
    kind, role = F.col("type"), F.col("role")
    has_title, plain = n(role == "title") > 0, n(~kind.isin("text", "shape", "line")) == 0
    layout = (
        F.when(has_title & ((n(role == "subtitle") > 0) | ((F.col("slide_no") == 1) & (n(kind == "text") <= 3) & plain)), "title").when(n(kind == "table") > 0, "table")
        .when((n(kind == "image") > 0) & (n(~kind.isin("image", "text")) == 0) & (n(role == "body") == 0), "image").when(n(role == "body") >= 2, "two_column").otherwise("title_body")
    )
    title = F.min(F.when((role == "title") & (F.size("lines") > 0), F.struct("el_no", F.col("lines")[0].alias("t")))).over(slide)["t"]
    return rows.withColumn("layout", layout).withColumn("slide_title", title).drop("height")


# -- SmartArt and warnings ---------------------------------------------------------------


def smartart_levels(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, el_no, nth, level, parent, text) of the texts of SmartArt: level 0 below the document, deeper by the connections.

    Levels grow by joining children to the level before until none is left; a
    text that no connection reaches has level 0, and a circle is walked once.
    """
    keys = [id_col, "slide_no", "el_no"]
    points, edges = rows_of(found, "points", id_col), staged(rows_of(found, "connections", id_col))
    now = staged(points.where("type = 'doc'").select(*keys, F.col("point").alias("child"), F.lit(-1).alias("level")))
    done, waves = now, [now]
    while True:
        below = now.select(*keys, F.col("child").alias("parent"), (F.col("level") + 1).alias("level")).join(edges, [*keys, "parent"])
        now = staged(below.join(done.select(*keys, "child"), [*keys, "child"], "left_anti").groupBy(*keys, "child").agg(F.min("level").alias("level")))
        if now.isEmpty():
            break
        waves.append(now)
        done = done.unionByName(now)
    level = done.withColumnRenamed("child", "point")
    parent = edges.groupBy(*keys, F.col("child").alias("point")).agg(F.min("parent").alias("parent"))
    texts = points.where("type not in ('doc', 'pres') and text <> ''")
    return texts.join(level, [*keys, "point"], "left").join(parent, [*keys, "point"], "left").select(*keys, "nth", F.coalesce("level", F.lit(0)).alias("level"), "parent", "text")


def warnings(found: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, el_no, code, detail): what a deck lost or only resembles, and scheme colours that no theme holds."""
    used = layer_chain(found, id_col).join(rows_of(found, "properties", id_col), [id_col, "holder", "level"]).select(id_col, "slide_no", "color_id").union(rows_of(found, "runs", id_col).select(id_col, "slide_no", "color_id"))
    lost = resolved(used.where("color_id is not null"), found, id_col).where("slot is not null").select(id_col, "slide_no", F.lit(None).cast("int").alias("el_no"), F.lit(NO_SLOT).alias("code"), F.col("slot").alias("detail")).distinct()
    return rows_of(found, "warnings", id_col).unionByName(lost)
