"""Text of files by their extension; a failing unit never loses the others.

Every reader takes bytes and gives an :class:`Extract`.  Office formats are
read as zip archives of XML with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from ..functions import text as tx

# What is read, and what an archive may hold.
TARGETS = (".doc", ".docx", ".txt", ".pdf", ".xlsx", ".xlsm", ".pptx", ".pptm", ".zip")
OLE_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_TOTAL_BYTES = 300, 50 << 20, 300 << 20
MAX_EMBEDDED, MAX_EMBEDDED_BYTES = 20, 20 << 20
ENCODINGS = ("utf-8-sig", "utf-8", "cp932")

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


@dataclass
class Extract:
    text: str = ""
    status: str = "ok"
    reason: str = ""
    units_total: int = 0
    units_ok: int = 0
    failures: list[tuple[str, str]] = field(default_factory=list)
    meta: dict[str, str] = field(default_factory=dict)


class Units:
    """Collects lines unit by unit and judges the whole at the end."""

    def __init__(self):
        self.lines: list[str] = []
        self.out = Extract()

    @contextmanager
    def unit(self, label: str) -> Iterator[list[str]]:
        self.out.units_total += 1
        try:
            yield self.lines
            self.out.units_ok += 1
        except Exception as e:  # a broken unit is reported, the rest goes on
            self.out.failures.append((label, str(e)[:200]))

    def done(self, nothing: str = "no text", has_text: Callable[[str], bool] = lambda line: bool(line.strip())) -> Extract:
        x, failed = self.out, self.out.failures
        x.text = "\n".join(self.lines)
        told = " / ".join(f"{a}: {b}" for a, b in failed[:5]) + (f" +{len(failed) - 5}" if len(failed) > 5 else "")
        if not x.text.strip():
            x.status, x.reason = ("error" if failed and not x.units_ok else "empty"), told or nothing
        elif failed:
            x.status, x.reason = "partial", f"{x.units_ok} of {x.units_total} units ({told})"
        elif not any(map(has_text, self.lines)):
            x.status, x.reason = "empty", nothing
        return x


# -- plain text -------------------------------------------------------------------


def read_plain(raw: bytes, name: str = "") -> Extract:
    """Strictly as UTF-8 (with or without mark) or CP932, then as detected, then as UTF-8 without what is broken."""
    if not raw.strip():
        return Extract(status="empty", reason="empty file")
    for encoding in ENCODINGS:
        try:
            text = raw.decode(encoding)
        except UnicodeDecodeError:
            continue
        return Extract(text, "ok" if text.strip() else "empty", meta={"encoding": encoding})
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(raw).best()
    except ImportError:
        best = None
    if best is not None:
        return Extract(str(best), "ok" if str(best).strip() else "empty", meta={"encoding": best.encoding})
    text = raw.decode("utf-8", "ignore")
    return Extract(text, "ok" if text.strip() else "error", "unknown encoding", meta={"encoding": "unknown"})


def read_plain_legacy(raw: bytes, name: str = "") -> Extract:
    text = raw.decode("utf-8-sig", "ignore")
    return Extract(text, "ok" if text.strip() else "empty")


# -- office formats ------------------------------------------------------------------


def _opened(raw: bytes) -> zipfile.ZipFile | Extract:
    try:
        return zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile:
        if raw.startswith(OLE_MAGIC):
            return Extract(status="protected", reason="encrypted or of an old format")
        return Extract(status="error", reason="not a zip archive")


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    return ET.fromstring(z.read(name))


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id -> (kind, target part)."""
    folder, _, base = part.rpartition("/")
    try:
        root = _xml(z, f"{folder}/_rels/{base}.rels")
    except KeyError:
        return {}
    out = {}
    for r in root:
        target = r.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        while "/../" in path:
            path = re.sub(r"[^/]+/\.\./", "", path, count=1)
        out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], path)
    return out


def _docx_text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out).strip()


def heading_level(style: str) -> int:
    """1 to 4 for heading and title styles, by their names; 0 for others."""
    low = style.lower()
    if low.startswith("heading") or style.startswith("見出し"):
        digits = "".join(filter(str.isdigit, style))
        return min(4, int(digits)) if digits and int(digits) else 1
    return int(low in ("title", "subtitle") or style in ("表題", "副題"))


def read_docx(raw: bytes, name: str = "", mark_headings: bool = True) -> Extract:
    z = _opened(raw)
    if isinstance(z, Extract):
        return z
    units = Units()
    try:
        body = _xml(z, "word/document.xml").find(W + "body")
    except (KeyError, ET.ParseError) as e:
        return Extract(status="error", reason=f"docx: {e}")
    styles: dict[str, str] = {}
    if "word/styles.xml" in z.namelist():
        for s in _xml(z, "word/styles.xml").iter(W + "style"):
            named = s.find(W + "name")
            styles[s.get(W + "styleId", "")] = named.get(W + "val", "") if named is not None else ""
    with units.unit("body") as lines:
        for p in body.findall(W + "p"):
            text = _docx_text(p)
            style = p.find(f"{W}pPr/{W}pStyle")
            level = heading_level(styles.get(style.get(W + "val", ""), style.get(W + "val", ""))) if style is not None and mark_headings else 0
            if text:
                lines.append("#" * level + " " + text if level else text)
    for i, table in enumerate(body.findall(W + "tbl"), 1):
        with units.unit(f"table {i}") as lines:
            for row in table.findall(W + "tr"):
                cells = ["\n".join(filter(None, map(_docx_text, c.findall(W + "p")))).strip() for c in row.findall(W + "tc")]
                if any(cells):
                    lines.append(" | ".join(filter(None, cells)))
    with units.unit("embedded") as lines:
        inner = _embedded(z)
        if inner:
            lines += ["# 埋め込みオブジェクト", *inner]
    return units.done()


def _column(i: int) -> str:
    out = ""
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_name(row: int, column: int) -> str:
    return f"{_column(column)}{row}"


def read_xlsx(raw: bytes, name: str = "") -> Extract:
    z = _opened(raw)
    if isinstance(z, Extract):
        return z
    units = Units()
    try:
        book, relations = _xml(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in _xml(z, "xl/sharedStrings.xml").findall(S + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    except (KeyError, ET.ParseError) as e:
        return Extract(status="error", reason=f"xlsx: {e}")
    for sheet in book.iter(S + "sheet"):
        title = sheet.get("name", "?")
        with units.unit(f"sheet {title}") as lines:
            lines.append(f"# Sheet: {title}")
            for row in _xml(z, relations[sheet.get(R + "id", "")][1]).iter(S + "row"):
                values = []
                for c in row.findall(S + "c"):
                    kind, v = c.get("t", "n"), c.find(S + "v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(S + "t"))
                    elif v is None or v.text is None:
                        continue
                    else:
                        value = shared[int(v.text)] if kind == "s" else {"1": "True", "0": "False"}[v.text] if kind == "b" else v.text
                    if value.strip():
                        values.append(f"{c.get('r', '')}={value.strip()}")
                if values:
                    lines.append(f"Row {row.get('r', '')}: " + " | ".join(values))
    out = units.done("no values", lambda line: not line.startswith("# Sheet: "))
    out.meta["sheets"] = str(out.units_total)
    return out


def _unique(lines: list[str], seen: set[str], text: str) -> None:
    """Lines of the text that this slide has not had, whatever their case."""
    for line in filter(None, map(str.strip, text.splitlines())):
        if line.lower() not in seen:
            seen.add(line.lower())
            lines.append(line)


def read_pptx(raw: bytes, name: str = "") -> Extract:
    z = _opened(raw)
    if isinstance(z, Extract):
        return z
    units = Units()
    try:
        deck, relations = _xml(z, "ppt/presentation.xml"), _relations(z, "ppt/presentation.xml")
    except (KeyError, ET.ParseError) as e:
        return Extract(status="error", reason=f"pptx: {e}")
    text_of = lambda x: "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in x.iter(A + "p"))
    for i, s in enumerate(deck.iter(P + "sldId"), 1):
        with units.unit(f"slide {i}") as lines:
            part = relations[s.get(R + "id", "")][1]
            lines.append(f"# Slide {i}")
            root, seen = _xml(z, part), set()
            for shape in root.iter():
                if shape.tag == P + "sp":
                    _unique(lines, seen, text_of(shape))
                elif shape.tag == A + "tbl":
                    for row in shape.iter(A + "tr"):
                        cells = [text_of(c).strip() for c in row.findall(A + "tc")]
                        _unique(lines, seen, " | ".join(filter(None, cells)))
                elif shape.tag.endswith("}cNvPr"):
                    for alt in ("descr", "title"):
                        _unique(lines, seen, shape.get(alt, ""))
            for kind, target in _relations(z, part).values():
                if kind == "notesSlide":
                    notes = [text_of(x).strip() for x in _xml(z, target).iter(P + "sp") if (ph := x.find(f".//{P}ph")) is None or ph.get("type") == "body"]
                    if any(notes):
                        lines.append("## Notes")
                        _unique(lines, seen, "\n".join(notes))
            rest = [t.text for t in root.iter() if t.tag.rpartition("}")[2] in ("t", "v") and t.text and t.text.strip() and not any(t.text.strip().lower() in x for x in seen)]
            if rest:
                lines.append("## XML Text")
                for t in rest:
                    _unique(lines, seen, t)
    with units.unit("embedded") as lines:
        inner = _embedded(z)
        if inner:
            lines += ["# 埋め込みオブジェクト", *inner]
    return units.done("no text", lambda line: not line.startswith("# Slide "))


def _embedded(z: zipfile.ZipFile) -> list[str]:
    """Texts of documents embedded in an office file; those that can't be read are named."""
    lines: list[str] = []
    inside = [i for i in sorted(z.infolist(), key=lambda i: i.filename.lower()) if "/embeddings/" in i.filename and not i.is_dir()]
    for n, info in enumerate(inside):
        base = info.filename.rpartition("/")[2]
        if n >= MAX_EMBEDDED or info.file_size > MAX_EMBEDDED_BYTES:
            lines.append(f"## {base}: skipped")
            continue
        got = extract(z.read(info), base) if _suffix(base) in TARGETS else Extract(status="unsupported")
        lines += [f"## {base}", got.text] if got.text.strip() else [f"## {base}: {got.status}"]
    return lines


# -- archives and dispatch -------------------------------------------------------------


def read_zip(raw: bytes, name: str = "") -> Extract:
    z = _opened(raw)
    if isinstance(z, Extract):
        return z
    units = Units()
    units.lines.append(f"# ZIP: {name}")
    count = total = 0
    for info in sorted(z.infolist(), key=lambda i: i.filename.lower()):
        path = info.filename.replace("\\", "/")
        base = path.rpartition("/")[2]
        if info.is_dir() or not base or base.startswith("_AI_CONTEXT_") or _suffix(base) not in TARGETS or _suffix(base) == ".zip":
            continue
        if count >= MAX_ENTRIES or (info.file_size <= MAX_ENTRY_BYTES and total + info.file_size > MAX_TOTAL_BYTES):
            units.lines.append("... more entries are not read")
            break
        if info.file_size > MAX_ENTRY_BYTES:
            units.lines.append(f"## {path}: too large")
            continue
        count, total = count + 1, total + info.file_size
        with units.unit(f"entry {path}") as lines:
            got = extract(z.read(info), base)
            lines += [f"## ZIP内ファイル {count}: {path}", got.text.strip() or tx.NO_TEXT, ""]
    out = units.done("nothing to read in the archive")
    if not count:
        out.status, out.reason = "empty", "nothing to read in the archive"
    out.meta["zip_entries_read"] = str(count)
    return out


def _suffix(name: str) -> str:
    at = name.rfind(".")
    return name[at:].lower() if at > 0 else ""


def _pdf(raw: bytes, name: str = "") -> Extract:
    try:
        from pypdf import PdfReader
    except ImportError:
        return Extract(status="needs_ocr", reason="no PDF library")
    units = Units()
    try:
        reader = PdfReader(io.BytesIO(raw))
        if reader.is_encrypted and not reader.decrypt(""):
            return Extract(status="protected", reason="encrypted")
    except Exception as e:
        return Extract(status="error", reason=f"pdf: {e}")
    for i, page in enumerate(reader.pages, 1):
        with units.unit(f"page {i}") as lines:
            text = (page.extract_text() or "").strip()
            if text:
                lines += [f"# Page {i}", text]
    out = units.done()
    return Extract(status="needs_ocr", reason="no text layer") if out.status == "empty" else out


READERS: dict[str, Callable[..., Extract]] = {
    ".txt": read_plain, ".docx": read_docx, ".xlsx": read_xlsx, ".xlsm": read_xlsx, ".pptx": read_pptx, ".pptm": read_pptx, ".zip": read_zip, ".pdf": _pdf,
    ".doc": lambda raw, name="": Extract(status="needs_conversion", reason="old format"),
}


def extract(raw: bytes, name: str) -> Extract:
    """The reader that the extension asks for; it never raises."""
    reader = READERS.get(_suffix(name))
    if reader is None:
        return Extract(status="unsupported", reason=f"extension {_suffix(name)}")
    try:
        return reader(raw, name)
    except Exception as e:
        return Extract(status="error", reason=str(e)[:200])
