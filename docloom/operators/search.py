"""Search over a collection: names, contents, recent changes, pages of a text.

Results are ordered, so that a limit always gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

BEFORE, BEHIND = 80, 160


def has_all(c: Column, query: str) -> Column:
    """Whether the lower-cased text holds every term of the query."""
    low, out = F.lower(c), F.lit(True)
    for term in query.lower().split():
        out = out & low.contains(term)
    return out


def by_name(files: DataFrame, query: str = "", extensions: tuple[str, ...] = (), limit: int = 100, path_col: str = "path") -> DataFrame:
    found = files.where(has_all(F.col(path_col), query))
    if extensions:
        found = found.where(tx.extension(F.col(path_col)).isin(*[e.lower() for e in extensions]))
    return found.orderBy(path_col).limit(limit)


def by_content(docs: DataFrame, query: str, limit: int | None = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, excerpt): from BEFORE characters ahead of the first term to BEHIND behind its start, on one line.

    The place is found in the lower-cased text, which may be longer than the text.
    """
    if not query.split():
        raise ValueError("no search term")
    text = tx.normalize_text(F.col(text_col))
    at = F.locate(query.lower().split()[0], F.lower(F.col("t"))) - 1
    start = F.greatest(F.lit(0), at - BEFORE)
    excerpt = F.replace(F.substr("t", start + 1, at + BEHIND - start), F.lit("\n"), F.lit(" / "))
    found = docs.select(id_col, text.alias("t")).where(has_all(F.col("t"), query)).select(id_col, excerpt.alias("excerpt"))
    return found if limit is None else found.orderBy(id_col).limit(limit)


def recent(files: DataFrame, now: Column, days: int = 7, limit: int = 100, time_col: str = "modified", path_col: str = "path") -> DataFrame:
    return files.where(F.col(time_col) >= now - F.make_dt_interval(F.lit(days))).orderBy(F.desc(time_col), F.desc(path_col)).limit(limit)


def page(c: Column, offset: int = 0, most: int = 20_000) -> Column:
    """(text, total, next): a slice of the normalized text and where it goes on, null at its end."""
    text = tx.normalize_text(c)
    total = F.length(text)
    return F.struct(F.substr(text, F.lit(offset + 1), F.lit(most)).alias("text"), total.alias("total"), F.when(total > offset + most, F.lit(offset + most)).alias("next"))
