"""A deck's specification as text, and the prompt around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .structure import fitting

# What the kinds are called.
LABELS = {"flow": "フロー（手順・流れ）", "cards": "カード（要点を並べる）", "compare": "比較（Before / After・左右対比）", "kpi": "数値（指標を大きく見せる）", "timeline": "年表（時系列）", "table": "表", "bullets": "箇条書き", "image_text": "画像 + 説明", "image": "画像だけ", "title_only": "題名だけ"}
MOST_CHARS = 12_000


def quoted(c: Column) -> Column:
    """A value for a line of YAML; quoted if it is empty, padded, or holds a sign that YAML would read."""
    s = F.coalesce(c, F.lit(""))
    safe = F.concat(F.lit('"'), F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" ")), F.lit('"'))
    return F.when((s == "") | s.rlike(r'[:\-#\[\]{}&*!|>%@`"\n]') | s.rlike(r"^\s|\s\z"), safe).otherwise(s)


def _list(head: str, values: Column, line) -> Column:
    """A heading and a line per value; null for none, so that it is left out."""
    return F.when(F.size(values) > 0, F.concat(F.lit(head), F.array_join(F.transform(values, line), "")))


def slide_texts(rows: DataFrame) -> DataFrame:
    """(page_id, slide_no, kind, text) of classified slides: one block of YAML each."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.col("kind"))
    item = lambda c: F.concat(F.lit("      - 見出し: "), quoted(F.get(c["lines"], F.lit(0))), F.coalesce(F.when(F.size(c["lines"]) > 1, F.concat(F.lit("\n        説明: "), quoted(F.array_join(F.slice(c["lines"], F.lit(2), F.size(c["lines"])), " ")))), F.lit("")), F.lit("\n"))
    row = lambda r: F.concat(F.lit("        - ["), F.array_join(F.transform(r, quoted), ", "), F.lit("]\n"))
    cells, heads = F.col("table.cells"), F.coalesce(F.col("table.header_rows"), F.lit(0))
    table = F.when(cells.isNotNull(), F.concat(F.lit("    表:\n"), F.coalesce(F.when(heads > 0, F.concat(F.lit("      見出し: ["), F.array_join(F.transform(F.get(cells, F.lit(0)), quoted), ", "), F.lit("]\n"))), F.lit("")), F.lit("      行:\n"), F.array_join(F.transform(F.slice(cells, heads + 1, F.size(cells)), row), "")))
    text = F.concat_ws(
        "",
        F.concat(F.lit("  - 番号: "), F.col("slide_no").cast("string"), F.lit("\n    題名: "), quoted(F.col("title")), F.lit("\n    型: "), quoted(label), F.lit("\n")),
        F.when(F.col("lead").isNotNull(), F.concat(F.lit("    リード: "), quoted(F.col("lead")), F.lit("\n"))),
        _list("    項目:\n", F.filter("cards", lambda c: F.size(c["lines"]) > 0), item),
        _list("    箇条書き:\n", F.col("body"), lambda b: F.concat(F.lit("      - "), quoted(b), F.lit("\n"))),
        table,
        _list("    画像:\n", F.col("images"), lambda m: F.concat(F.lit("      - ファイル: "), quoted(m["src"]), F.coalesce(F.when(m["alt"] != "", F.concat(F.lit("  # "), m["alt"])), F.lit("")), F.lit("\n"))),
    )
    return rows.select("page_id", "slide_no", "kind", text.alias("text"))


def prompts(slide_rows: DataFrame, titles: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """(page_id, prompt, kinds, n_slides, dropped): the specification of each deck within ``most`` characters.

    Slides are dropped from the end.  ``titles`` has page_id and title.  Only
    kinds that occur are explained.
    """
    texts = slide_texts(slide_rows)
    total = texts.groupBy("page_id").agg(F.count("*").alias("total"))
    kept = fitting(texts, "text", ["page_id"], ["slide_no"], most)
    parts = F.array_sort(F.collect_list(F.struct("slide_no", "kind", "text")))
    decks = kept.groupBy("page_id").agg(parts.alias("parts"))
    kinds = F.array_distinct(F.transform("parts", lambda p: p["kind"]))
    named = F.array_join(F.transform(kinds, lambda k: F.concat(F.lit("  - "), F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), k))), "\n")
    spec = F.concat(F.lit("資料: "), quoted(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("（題名なし）"))), F.lit("\n枚数: "), F.size("parts").cast("string"), F.lit("\nページ:\n"), F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    joined = total.join(decks, "page_id", "left").join(titles, "page_id", "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<struct<slide_no:int,kind:string,text:string>>")))
    return joined.select("page_id", F.concat(F.lit("型:\n"), named, F.lit("\n\n--- 仕様 ---\n"), spec).alias("prompt"), kinds.alias("kinds"), F.size("parts").alias("n_slides"), (F.col("total") - F.size("parts")).alias("dropped"))
