"""Slides and elements of presentations, in the columns of an element table.

Shapes of groups are placed in the page by the group's own frame.  Lengths
are points.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import COLUMNS as PAGE_COLUMNS
from .readers import A, P, R, _relations, _xml

EMU = 12_700
DGM, CHART = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}", "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
# What is left out, which placeholders have which role, how shapes are called, and codes of warnings.
SKIPPED = ("ftr", "dt", "sldNum")
DECOR = ("footer", "page_number", "confidential", "logo", "bar", "cover_background", "decor")
ROLES = {"title": "title", "ctrTitle": "title", "subTitle": "subtitle", "body": "body", "obj": "body"}
NAMED = ("title", "subtitle", "body", "caption", "card", "footer", "header")
SHAPES = {"rect": "rect", "roundRect": "rounded_rect", "ellipse": "ellipse", "flowChartProcess": "rect", "flowChartAlternateProcess": "rounded_rect", "snip1Rect": "rect", "triangle": "triangle", "diamond": "diamond", "rightArrow": "arrow_right", "parallelogram": "parallelogram"}
APPROXIMATED, NO_IMAGE, CROPPED, TEXT_ONLY, NO_SMARTART, NO_CHART, UNSUPPORTED = "SHAPE_APPROXIMATED", "IMAGE_READ_FAILED", "IMAGE_CROP_IGNORED", "SMARTART_TEXT_ONLY", "SMARTART_UNSUPPORTED", "CHART_UNSUPPORTED", "ELEMENT_UNSUPPORTED"
TITLE_SHARE, TITLE_CHARS, TITLE_POINTS = 0.25, 80, 20.0

Frame = tuple[float, float, float, float]


def moved(box: Frame, frame: tuple[Frame, Frame] | None) -> Frame:
    """A box in a group's inner coordinates, in those of the group's parent."""
    if frame is None:
        return box
    (ox, oy, w, h), (cx, cy, cw, ch) = frame
    sx, sy = w / cw, h / ch
    return ox + (box[0] - cx) * sx, oy + (box[1] - cy) * sy, box[2] * sx, box[3] * sy


def _pair(x: ET.Element | None, a: str, b: str) -> tuple[float, float] | None:
    return (int(x.get(a, 0)) / EMU, int(x.get(b, 0)) / EMU) if x is not None else None


def _frame(x: ET.Element | None, off: str = "off", ext: str = "ext") -> Frame | None:
    if x is None:
        return None
    at, size = _pair(x.find(A + off), "x", "y"), _pair(x.find(A + ext), "cx", "cy")
    return (*at, *size) if at and size else None


def _box(shape: ET.Element, frame) -> Frame | None:
    for path in (f"{P}spPr/{A}xfrm", f"{P}xfrm"):
        if (box := _frame(shape.find(path))) is not None:
            return moved(box, frame)
    return None


def _cropped(picture: ET.Element) -> bool:
    """Whether more than a thousandth of a side is cut off."""
    cut = picture.find(f"{P}blipFill/{A}srcRect")
    return cut is not None and any(abs(int(cut.get(side, 0))) > 100 for side in "ltrb")


def _turned(shape: ET.Element) -> float | None:
    """Degrees that a shape is turned by, two decimals."""
    at = shape.find(f"{P}spPr/{A}xfrm")
    turn = int(at.get("rot", 0)) / 60_000 if at is not None else 0.0
    return round(turn, 2) if abs(turn) > 0.01 else None


def _paragraphs(body: ET.Element | None) -> list[tuple[str, int, float]]:
    """(text, level, largest size) of the paragraphs that have text."""
    out = []
    for p in body.findall(A + "p") if body is not None else []:
        parts, size = [], 0.0
        for r in p:
            if r.tag == A + "br":
                parts.append("\n")
            elif r.tag in (A + "r", A + "fld"):
                parts.append("".join(t.text or "" for t in r.findall(A + "t")))
                pr = r.find(A + "rPr")
                size = max(size, int(pr.get("sz", 0)) / 100 if pr is not None else 0.0)
        text, pr = "".join(parts).strip(), p.find(A + "pPr")
        if text:
            out.append((text, int(pr.get("lvl", 0)) if pr is not None else 0, size))
    return out


class _Deck:
    def __init__(self, raw: bytes):
        self.z = zipfile.ZipFile(io.BytesIO(raw))
        self.assets: dict[str, str] = {}

    def asset(self, part: str) -> str | None:
        """The id of a picture, one per content."""
        try:
            digest = hashlib.sha1(self.z.read(part)).hexdigest()
        except KeyError:
            return None
        return self.assets.setdefault(digest, f"img{len(self.assets) + 1:03d}{posixpath.splitext(part)[1].lower()}")

    def elements(self, tree: ET.Element, relations: dict, frame=None) -> Iterator[dict]:
        for s in tree:
            name = next((n.get("name", "") for n in s.iter(P + "cNvPr")), "")
            ph = s.find(f".//{P}nvPr/{P}ph")
            kind = ph.get("type", "obj") if ph is not None else None
            if kind in SKIPPED:
                continue
            if name.rstrip("0123456789") in DECOR:
                continue
            named = name.split(":")[0].strip().lower()
            role = named if named in NAMED else ROLES.get(kind or "")
            base = {"role": role, "lines": [], "box": _box(s, frame), "size": 0.0, "columns": None, "column": None, "side": None, "pair_row": None, "header_rows": 0, "cells": None, "src": None, "alt": None, "keep_with_next": False, "asset": None, "shape": None, "name": name, "turned": _turned(s), "xml": s, "warn": None, "points": None}
            if s.tag == P + "grpSp":
                inner, outer = s.find(f"{P}grpSpPr/{A}xfrm"), None
                outer, child = _frame(inner), _frame(inner, "chOff", "chExt")
                at = (moved(outer, frame), child) if outer and child and child[2] and child[3] else frame
                yield from self.elements(s, relations, at)
            elif s.tag == P + "pic":
                blip = s.find(f".//{A}blip")
                part = relations.get(blip.get(R + "embed", ""), ("", ""))[1] if blip is not None else ""
                alt = next((n.get("descr", "") for n in s.iter(P + "cNvPr")), "")
                found = self.asset(part)
                yield base | {"type": "image" if found else "unsupported", "src": found, "alt": alt, "warn": NO_IMAGE if not found else CROPPED if _cropped(s) else None}
            elif s.tag == P + "graphicFrame":
                table = s.find(f".//{A}tbl")
                if table is None:
                    yield base | self.framed(s, relations)
                    continue
                rows = [["\n".join(t for t, *_ in _paragraphs(c.find(A + "txBody"))) for c in tr.findall(A + "tc")] for tr in table.findall(A + "tr")]
                pr = table.find(A + "tblPr")
                yield base | {"type": "table", "cells": rows, "lines": ["\t".join(r) for r in rows], "header_rows": int(pr is not None and pr.get("firstRow") == "1")}
            elif s.tag == P + "cxnSp":
                yield base | {"type": "line"}
            elif s.tag == P + "sp":
                paragraphs = _paragraphs(s.find(P + "txBody"))
                geometry = s.find(f"{P}spPr/{A}prstGeom")
                drawn = ph is None and geometry is not None and not (s.find(f"{P}nvSpPr/{P}cNvSpPr") is not None and s.find(f"{P}nvSpPr/{P}cNvSpPr").get("txBox") == "1")
                if not paragraphs and not drawn:
                    continue
                base |= {"lines": [t for t, *_ in paragraphs], "size": max((z for *_, z in paragraphs), default=0.0)}
                painted = s.find(f"{P}spPr/{A}solidFill") is not None or s.find(f"{P}spPr/{A}ln/{A}solidFill") is not None
                if drawn and (painted or not paragraphs):
                    preset = geometry.get("prst", "")
                    yield base | {"type": "shape", "shape": SHAPES.get(preset, "rect"), "warn": None if preset in SHAPES else APPROXIMATED}
                else:
                    yield base | {"type": "text", "role": role or "body", "warn": APPROXIMATED if drawn and geometry.get("prst", "") not in SHAPES else None}

    def framed(self, frame: ET.Element, relations: dict) -> dict:
        """What is known of a frame that holds no table: texts of SmartArt with their points, the title of a chart."""
        ids, chart = frame.find(f".//{DGM}relIds"), frame.find(f".//{CHART}chart")
        if ids is not None:
            points = self.points(relations.get(ids.get(R + "dm", ""), ("", ""))[1])
            texts = [t for _, kind, t in points[0] if kind not in ("doc", "pres") and t]
            if texts:
                return {"type": "text", "role": "body", "lines": texts, "points": points, "warn": TEXT_ONLY}
            return {"type": "unsupported", "shape": "smartart", "warn": NO_SMARTART}
        if chart is not None:
            try:
                title = _xml(self.z, relations.get(chart.get(R + "id", ""), ("", ""))[1]).find(f".//{CHART}title")
            except (KeyError, ET.ParseError):
                title = None
            return {"type": "unsupported", "shape": "chart", "alt": "".join(t.text or "" for t in title.iter(A + "t")) if title is not None else None, "warn": NO_CHART}
        return {"type": "unsupported", "warn": UNSUPPORTED}

    def points(self, part: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, int]]]:
        """((id, type, text) of the points, (parent, child, place) of the connections) of a SmartArt part."""
        try:
            tree = _xml(self.z, part)
        except (KeyError, ET.ParseError):
            return [], []
        points = [(p.get("modelId", ""), p.get("type", "node"), "".join(t.text or "" for t in p.iter(A + "t")).strip()) for p in tree.iter(DGM + "pt")]
        return points, [(c.get("srcId", ""), c.get("destId", ""), int(c.get("srcOrd", 0))) for c in tree.iter(DGM + "cxn") if c.get("type", "parOf") == "parOf"]

    def slides(self) -> Iterator[dict]:
        deck, relations = _xml(self.z, "ppt/presentation.xml"), _relations(self.z, "ppt/presentation.xml")
        page = _pair(deck.find(P + "sldSz"), "cx", "cy") or (960.0, 540.0)
        for n, s in enumerate(deck.iter(P + "sldId")):
            part = relations[s.get(R + "id", "")][1]
            own = _relations(self.z, part)
            elements = list(self.elements(_xml(self.z, part).find(f"{P}cSld/{P}spTree"), own))
            infer_title(elements, page[1])
            title = next((e["lines"][0] for e in elements if e["role"] == "title" and e["lines"]), None)
            notes = [t for kind, target in own.values() if kind == "notesSlide" for x in _xml(self.z, target).iter(P + "sp") if (ph := x.find(f".//{P}ph")) is not None and ph.get("type") == "body" for t, *_ in _paragraphs(x.find(P + "txBody"))]
            yield {"title": title, "layout": layout_of(elements, n), "elements": elements, "notes": "\n".join(notes), "part": part, "height": page[1]}


def infer_title(elements: list[dict], height: float) -> None:
    """Without a title, the short text with the largest letters in the top of the page becomes it; the first of equals."""
    if any(e["role"] == "title" for e in elements):
        return
    top = [e for e in elements if e["type"] == "text" and e["box"] and e["box"][1] <= height * TITLE_SHARE and 0 < len("".join(e["lines"])) <= TITLE_CHARS and len(e["lines"]) <= 2 and e["size"] >= TITLE_POINTS]
    if top:
        max(top, key=lambda e: e["size"])["role"] = "title"


def layout_of(elements: list[dict], nth: int) -> str:
    kinds, roles = [e["type"] for e in elements], [e["role"] for e in elements]
    titled = "title" in roles
    if titled and ("subtitle" in roles or (nth == 0 and kinds.count("text") <= 3 and set(kinds) <= {"text", "shape", "line"})):
        return "title"
    if "table" in kinds:
        return "table"
    if "image" in kinds and set(kinds) <= {"image", "text"} and "body" not in roles:
        return "image"
    return "two_column" if roles.count("body") >= 2 else "title_body" if elements else "blank"


def slides_of(raw: bytes) -> list[dict]:
    return list(_Deck(raw).slides())


COLUMNS = [*PAGE_COLUMNS, ("shape", pa.string(), "string"), ("x", pa.float64(), "double"), ("y", pa.float64(), "double"), ("w", pa.float64(), "double"), ("h", pa.float64(), "double"), ("size_pt", pa.float64(), "double"), ("notes", pa.string(), "string"), ("name", pa.string(), "string"), ("turned", pa.float64(), "double")]


def elements(decks: DataFrame, id_col: str = "page_id", content_col: str = "content") -> DataFrame:
    """One row per element of every deck, numbered like those of pages; a deck that can't be read has none."""
    kind = dict(decks.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    slides = slides_of(raw.as_py() or b"")
                except (zipfile.BadZipFile, KeyError, ValueError, ET.ParseError):
                    slides = []
                for s, slide in enumerate(slides, 1):
                    for e, element in enumerate(slide["elements"], 1):
                        ids.append(i)
                        x, y, w, h = element["box"] or (None,) * 4
                        rows.append(element | {"slide_no": s, "slide_title": slide["title"], "layout": slide["layout"], "notes": slide["notes"], "el_no": e, "x": x, "y": y, "w": w, "h": h, "size_pt": element["size"]})
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array([r[c] for r in rows], t) for c, t, _ in COLUMNS)], names=[id_col, *(c for c, _, _ in COLUMNS)])

    schema = f"{id_col} {kind}, " + ", ".join(f"{c} {s}" for c, _, s in COLUMNS)
    return decks.select(F.col(id_col), F.col(content_col).alias("content")).mapInArrow(run, schema)


def image_assets(pages: DataFrame) -> DataFrame:
    """(sha1, mime, first_page, n) of the pictures that pages hold as data URIs; one row per content."""
    spot = r"data:([^;,\"']+)?(;base64)?,([^\"'\s>)]*)"
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(f"({spot})"), F.lit(1))).alias("uri"))
    raw = F.when(F.regexp_extract("uri", spot, 2) != "", F.try_to_binary(F.regexp_extract("uri", spot, 3), F.lit("base64"))).otherwise(F.try_url_decode(F.regexp_extract("uri", spot, 3)).cast("binary"))
    rows = found.select("page_id", F.coalesce(F.nullif(F.regexp_extract("uri", spot, 1), F.lit("")), F.lit("image/png")).alias("mime"), raw.alias("raw")).where("raw is not null")
    return rows.groupBy(F.sha1("raw").alias("sha1")).agg(F.min_by("mime", "page_id").alias("mime"), F.min("page_id").alias("first_page"), F.count("*").alias("n"))
