"""Scalar text rules as Column expressions.

Line breaks and white space follow Unicode: lines end at any of the breaks in
``LINE_BREAK``, and stripping takes every white-space character.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = "[\\s\x1c-\x1f]"
HEADING = "^#{1,4} "
MAX_SUMMARY, EXCERPT, ONE_LINE = 1200, 300, 160
CHARS_PER_TOKEN = 1.4
#: Fixed value: shown in place of a summary or text that could not be extracted.
NO_TEXT = "本文抽出不可。ファイル名・パス・拡張子を参照。"
FORBIDDEN_IN_NAMES = r'[\\/:*?"<>|]'


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at both ends; most texts have only blanks there, which go without a pattern."""
    ends = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    return let(F.trim(c), lambda t: F.when(ends(t).rlike(f"(?U){SPACE}"), F.regexp_replace(t, f"(?U)^{SPACE}+|{SPACE}+\\z", "")).otherwise(t))


def normalize_text(c: Column) -> Column:
    """Carriage returns to newlines, at most one blank line, single spaces, stripped (CRLF makes two newlines)."""
    c = F.translate(c, "\r", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def split_lines(c: Column) -> Column:
    """The lines of a text; a final break opens no further line."""
    none = F.array().cast("array<string>")
    without_last = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return F.when(c == "", none).otherwise(let(F.split(c, LINE_BREAK), without_last))


def filled_lines(c: Column) -> Column:
    """Stripped lines that are not empty."""
    return F.filter(F.transform(split_lines(c), strip), lambda x: x != "")


def cut(c: Column, most: int, mark: str = "...") -> Column:
    return let(c, lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit(mark))).otherwise(x))


def is_heading(c: Column) -> Column:
    return c.rlike(HEADING)


def plain_summary(c: Column, lines: int = 20, most: int = MAX_SUMMARY) -> Column:
    """The first lines of the text, cut."""
    shown = lambda t: F.when(t == "", F.lit(NO_TEXT)).otherwise(cut(F.array_join(F.slice(filled_lines(t), 1, lines), "\n"), most))
    return let(normalize_text(c), shown)


def heading_summary(c: Column, most: int = MAX_SUMMARY, headings: int = 30, lead_lines: int = 8, lead_chars: int = 400) -> Column:
    """Headings joined on one line, then the lead; the lead ends with the line that makes it long enough."""

    def shown(lines: Column) -> Column:
        heads = F.transform(F.slice(F.filter(lines, is_heading), 1, headings), lambda h: strip(F.regexp_replace(h, "^#+", "")))
        body = F.filter(lines, lambda x: ~is_heading(x))
        lead = F.aggregate(
            F.slice(body, 1, lead_lines),
            F.lit(""),
            lambda acc, x: F.when(F.length(acc) > lead_chars, acc).otherwise(F.when(acc == "", x).otherwise(F.concat(acc, F.lit("\n"), x))),
        )
        head = let(heads, lambda h: F.when(F.size(h) > 0, F.concat(F.lit("見出し: "), F.array_join(h, " / "))))
        return F.when(F.size(lines) == 0, F.lit(NO_TEXT)).otherwise(cut(F.concat_ws("\n", head, F.nullif(lead, F.lit(""))), most))

    return let(filled_lines(normalize_text(c)), shown)


def line_tail(c: Column, n: int) -> Column:
    """The last n characters, from the first line start among them."""
    tail = F.when(F.length(c) > n, F.expr("''") if n <= 0 else F.substring(c, -n, n)).otherwise(c if n > 0 else F.lit(""))
    at = F.locate("\n", tail)
    return F.regexp_replace(F.when(at > 0, F.substr(tail, at + 1)).otherwise(tail), r"^\n+|\n+\z", "")


def code_fence(c: Column) -> Column:
    """A run of backticks longer than any in the text, three at least."""
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), F.lit(1)), F.length))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(longest + 1, F.lit(3))))


def token_estimate(c: Column, per_token: float = CHARS_PER_TOKEN) -> Column:
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(F.length(c) / F.lit(per_token)).cast("int")))


def excerpt(c: Column, most: int = EXCERPT) -> Column:
    return cut(c, most)


def one_line(c: Column, most: int = ONE_LINE) -> Column:
    return cut(F.array_join(filled_lines(c), " / "), most)


def format_size(c: Column) -> Column:
    """Bytes as B, KB, MB or GB with two decimals, halves to even, in integer arithmetic."""

    def scaled(shift: int, unit: str) -> Column:
        scale = 1 << shift
        hundred = c.cast("decimal(28,0)") * 100
        #: a quotient of decimals would be rounded, so only what divides evenly is divided
        rest = (hundred % scale).cast("long")
        whole = ((hundred - rest) / scale).cast("long")
        up = (rest > scale // 2) | ((rest == scale // 2) & (whole % 2 == 1))
        n = whole + up.cast("int")
        return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(unit))

    return F.when(c >= 1 << 30, scaled(30, " GB")).when(c >= 1 << 20, scaled(20, " MB")).when(c >= 1 << 10, scaled(10, " KB")).otherwise(F.concat(c.cast("string"), F.lit(" B")))


def clean_filename(c: Column) -> Column:
    return F.regexp_replace(c, FORBIDDEN_IN_NAMES, "_")


def is_same_or_child(path: Column, parent: Column) -> Column:
    """By whole segments: a sibling whose name begins alike is no child."""
    trimmed = F.rtrim(parent, F.lit("/"))
    return (F.rtrim(path, F.lit("/")) == trimmed) | path.startswith(F.concat(trimmed, F.lit("/")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def group_key(relative: Column) -> Column:
    """The first folder of a relative path; ``_root`` for files at the top."""
    return F.when(relative.contains("/"), F.split_part(relative, F.lit("/"), F.lit(1))).otherwise(F.lit("_root"))


def fold_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


def fill_template(c: Column, values: dict[str, Column]) -> Column:
    """``{key}`` replaced by its value; unknown keys stay."""
    for key, value in values.items():
        c = F.replace(c, F.lit("{" + key + "}"), value.cast("string"))
    return c


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


#: Lines that change from run to run, by their beginnings (fixed values).
VOLATILE = ("GeneratedAt:", "- 生成日時:")


def content_hash(c: Column, volatile: tuple[str, ...] = VOLATILE, section: str = "## LastDiff") -> Column:
    """SHA-256 of the lines without volatile ones and without one section (up to the next ``## `` line)."""
    state = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        opens = strip(line) == section
        closes = acc["inside"] & line.startswith("## ") & ~opens
        inside = opens | (acc["inside"] & ~closes)
        drop = inside
        for v in volatile:
            drop = drop | line.startswith(v)
        return F.struct(inside.alias("inside"), F.when(drop, acc["kept"]).otherwise(F.array_append(acc["kept"], line)).alias("kept"))

    return F.sha2(F.array_join(F.aggregate(split_lines(c), state, step, lambda acc: acc["kept"]), "\n"), 256)
