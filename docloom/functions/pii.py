"""Sensitive values: counting, masking and a dictionary of own patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "＜伏字＞"
#: The built-in kinds in the order in which they mask.
BUILT_IN = {
    "card": r"(?<![\d-])\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}(?![\d-])|(?<!\d)\d{15,16}(?!\d)",
    "my_number": r"(?<![\d-])\d{12}(?!\d)|(?<![\d-])\d{4}-\d{4}-\d{4}(?!-?\d)",
    "phone": r"(?<![\d-])0\d{1,4}-\d{1,4}-\d{4}(?![\d-])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
UNICODE = "(?U)"
#: What every hit of the kinds of digits holds, also where others were masked before.
DIGITS = UNICODE + r"\d{4}[- ]\d{4}|\d{12}|\d-\d{1,4}-\d"


def dictionary(lines: Iterable[str]) -> list[str]:
    """Patterns of a dictionary: a literal per line, or ``regex:`` and a pattern; comments and bad patterns go."""
    out = []
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        if not line.startswith("regex:"):
            out.append(re.escape(line))
            continue
        try:
            re.compile(line[6:])
        except re.error:
            continue
        out.append(line[6:])
    return out


def read_dictionary(spark, path: str) -> list[str]:
    """The dictionary file at a path that Spark reads; a few lines."""
    return dictionary(r["value"] for r in spark.read.text(path).collect())


def patterns(own: Iterable[str] = ()) -> list[tuple[str, str]]:
    return [(k, UNICODE + p) for k, p in BUILT_IN.items()] + [("dictionary", p) for p in own]


def may_hold(c: Column, kind: str) -> Column:
    """Whether a text can have hits of a kind at all; one short look tells it of most texts."""
    if kind == "dictionary":
        return c.isNotNull()
    return c.contains("@") if kind == "email" else c.rlike(DIGITS)


def masked_steps(c: Column, own: Iterable[str] = ()) -> list[tuple[str, str, Column]]:
    """(kind, pattern, the text that it sees), in order, and the masked text behind the last."""
    out, now, gate = [], c, None
    every = patterns(own)
    for at, (kind, p) in enumerate(every):
        out.append((kind, p, now))
        here = "email" if kind == "email" else "dictionary" if kind == "dictionary" else "digits"
        if here != gate:
            start, gate = now, here
        now = F.regexp_replace(now, p, MASK)
        after = every[at + 1][0] if at + 1 < len(every) else None
        if here != "dictionary" and (here == "email" or after in ("email", "dictionary", None)):
            now = F.when(may_hold(c, kind), now).otherwise(start)
    return [*out, ("", "", now)]


def scan(c: Column, own: Iterable[str] = ()) -> Column:
    """Map from kind to hits; kinds without a hit are left out.  Each pattern looks at the original text."""
    total: dict[str, Column] = {}
    for kind, p in patterns(own):
        hits = F.when(may_hold(c, kind), F.regexp_count(c, F.lit(p))).otherwise(0)
        total[kind] = total[kind] + hits if kind in total else hits
    every = F.create_map(*[x for kind, n in total.items() for x in (F.lit(kind), n)])
    return F.map_filter(every, lambda _, n: n > 0)


def mask(c: Column, own: Iterable[str] = ()) -> Column:
    """The text with every hit replaced, pattern after pattern."""
    return masked_steps(c, own)[-1][2]


def mask_counts(c: Column, own: Iterable[str] = ()) -> Column:
    """Map from kind to replacements; a pattern sees what the ones before have left."""
    total: dict[str, Column] = {}
    for kind, p, seen in masked_steps(c, own)[:-1]:
        hits = F.when(may_hold(c, kind), F.regexp_count(seen, F.lit(p))).otherwise(0)
        total[kind] = total[kind] + hits if kind in total else hits
    every = F.create_map(*[x for kind, n in total.items() for x in (F.lit(kind), n)])
    return F.map_filter(every, lambda _, n: n > 0)


def merge_findings(findings: DataFrame, column: str = "findings") -> DataFrame:
    """(kind, hits) over all rows' maps."""
    return findings.select(F.explode(column).alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("hits"))


def without_hits(rows: DataFrame, column: str = "text", own: Iterable[str] = ()) -> DataFrame:
    """Rows whose text holds no sensitive value."""
    clean = F.lit(True)
    for _, p in patterns(own):
        clean = clean & ~F.col(column).rlike(p)
    return rows.where(clean)
