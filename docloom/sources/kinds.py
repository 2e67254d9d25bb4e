"""What an uploaded file is, by its content."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_NAMES, PPTX_NAMES = (".html", ".htm"), (".pptx", ".potx", ".ppsx")
SNIFFED = 400


def plain_kind(content: Column, name: Column) -> Column:
    """``zip``, ``html`` or ``unknown`` by the first bytes, then by the name; built-in functions only."""
    head = F.lower(F.decode(F.translate(F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1"), "\0", " ").cast("binary"), "UTF-8"))
    named = F.lit(False)
    for n in HTML_NAMES:
        named = named | F.lower(name).endswith(n)
    return F.when(F.hex(F.substring(content, 1, 2)) == "504B", "zip").when(head.contains("<html") | head.contains("<!doctype") | named, "html").otherwise("unknown")


def kind_of(raw: bytes, name: str = "") -> str:
    """``pptx``, ``html`` (also an archive with pages) or why it is neither."""
    if raw[:2] == b"PK":
        try:
            names = zipfile.ZipFile(io.BytesIO(raw)).namelist()
        except zipfile.BadZipFile:
            return "error: broken archive"
        return "pptx" if "[Content_Types].xml" in names and any(n.startswith("ppt/") for n in names) else "html"
    head, low = raw[:SNIFFED].lower(), name.lower()
    if b"<html" in head or b"<!doctype" in head or low.endswith(HTML_NAMES):
        return "html"
    return "error: broken presentation" if low.endswith(PPTX_NAMES) else "error: neither presentation nor page"


def page_of_archive(raw: bytes) -> tuple[str, bytes, dict[str, bytes]] | None:
    """(name, page, all files): the page nearest to the top, an index first; None if there is none."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        files = {i.filename.replace("\\", "/"): z.read(i) for i in z.infolist() if not i.is_dir() and not i.filename.startswith("__MACOSX/")}
    pages = [n for n in files if n.lower().endswith(HTML_NAMES)]
    if not pages:
        return None
    best = min(pages, key=lambda n: (n.count("/"), not n.rpartition("/")[2].lower().startswith("index"), n))
    return best, files[best], files
