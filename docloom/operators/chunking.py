"""Texts cut into chunks: by lines, or by headings and paragraphs with an overlap."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import pii
from ..functions import text as tx

CHUNK_CHARS, OVERLAP = 12_000, 0.12
#: Characters of text, about, that a task of Python has as objects at a time.
SLICE_CHARS = 1_000_000
_HEADING = re.compile(tx.HEADING)


def by_lines(text: str, most: int = CHUNK_CHARS) -> list[str]:
    """Lines packed greedily, each with its line end; longer lines are cut hard.  An empty text is one empty chunk."""
    groups: list[list[str]] = [[]]
    room = most
    for line in text.splitlines():
        need = len(line) + 1
        if need > most:
            groups += [[line[i : i + most]] for i in range(0, len(line), most)] + [[]]
            room = most
            continue
        if need > room and groups[-1]:
            groups.append([])
            room = most
        groups[-1].append(line)
        room -= need
    return ["\n".join(g) for g in groups if g] or [""]


def _packed(parts: list[str], glue: str, most: int) -> list[str]:
    """Neighbouring parts joined while they fit."""
    out: list[str] = []
    for p in parts:
        if out and (not out[-1] or len(out[-1]) + len(glue) + len(p) <= most):
            out[-1] = out[-1] + glue + p if out[-1] else p
        else:
            out.append(p)
    return [p for p in out if p]


def _tail(text: str, n: int) -> str:
    if n <= 0:
        return ""
    _, cut, rest = text[-n:].partition("\n")
    return (rest if cut else text[-n:]).strip("\n")


def by_sections(text: str, most: int = CHUNK_CHARS, overlap: float = OVERLAP) -> list[str]:
    """Sections from heading to heading, packed; a chunk begins with the tail of the one before.

    A section that is too long falls into paragraphs, a paragraph into lines.
    What still exceeds the limit with its overlap is cut hard.
    """
    sections: list[list[str]] = []
    for line in text.splitlines():
        if not sections or _HEADING.match(line):
            sections.append([])
        sections[-1].append(line)
    blocks: list[str] = []
    for s in ("\n".join(x) for x in sections):
        for p in [s] if len(s) <= most else _packed(s.split("\n\n"), "\n\n", most):
            blocks += [p] if len(p) <= most else by_lines(p, most)
    out: list[str] = []
    held = ""
    for b in blocks:
        if held and len(held) + 1 + len(b) > most:
            out.append(held)
            held = _tail(held, max(0, int(most * overlap)))
        held = f"{held}\n{b}" if held else b
        while len(held) > most:
            out.append(held[:most])
            held = held[most:]
    return out + [held] if held else out or [""]


def chunk(docs: DataFrame, mode: str = "sections", most: int = CHUNK_CHARS, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk_index from 1, chunk_count, text) of the normalized texts."""
    cutter = (lambda t: by_lines(t, most)) if mode == "lines" else (lambda t: by_sections(t, most, overlap))

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, parts, held = [], [], 0
            for i, text in enumerate(texts):
                rows.append(i)
                parts.append(cutter(text.as_py()))
                held += sum(map(len, parts[-1]))
                if held >= SLICE_CHARS or i + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(parts, pa.list_(pa.string()))], names=[id_col, "parts"])
                    rows, parts, held = [], [], 0

    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(id_col, tx.normalize_text(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    parts = texts.mapInArrow(run, f"{id_col} {kind}, parts array<string>")
    return parts.select(id_col, F.size("parts").alias("chunk_count"), F.posexplode("parts").alias("pos", "text")).select(id_col, (F.col("pos") + 1).alias("chunk_index"), "chunk_count", "text")


def unblocked(chunks: DataFrame, own=()) -> DataFrame:
    """Chunks without sensitive values; chunk_count stays as it was, so blocked documents have gaps."""
    return pii.without_hits(chunks, "text", own)
