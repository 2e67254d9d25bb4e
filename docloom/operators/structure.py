"""What kind of diagram a slide wants to be, by rules over its elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx

# The kinds, the words that name them, and the marks of each.
WORDS = {"flow": ["フロー", "手順", "流れ", "ステップ"], "cards": ["カード", "3分割", "要点", "ポイント"], "compare": ["比較", "Before", "対比"], "kpi": ["KPI", "数値", "指標"], "timeline": ["年表", "タイムライン", "沿革"]}
KINDS = [*WORDS, "table", "bullets", "image_text", "image", "title_only"]
STEP = r"(?i)(^|\s)([①-⑳]|[0-9]{1,2}\s*[.．)）]|STEP\s*[0-9]|第\s*[0-9]+\s*(段|歩|ステップ))"
ARROW = "→|⇒|▶|->|=>"
NUMBER = r"[0-9０-９][0-9０-９,，.．]*\s*(%|％|件|人|時間|分|秒|日|週|月|年|円|万|億|倍|点|個|台|本|回|kg|km|GB|MB)"
YEAR = r"(19|20)[0-9]{2}\s*(年|/|-)"
COMPARE = r"(?i)(before|after|as[-\s]?is|to[-\s]?be|現行|現状|導入前|導入後|改善前|改善後|従来|新方式|旧|新)"
KEY = ["page_id", "slide_no"]
#: How many times the height of the lowest the tallest of several cards may have.
CARD_RATIO = 1.6


def plain_text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def word_kind(title: Column) -> Column:
    """The first kind one of whose words is in the title; null for none."""
    low, out = F.lower(title), F
    for kind, words in WORDS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        out = out.when(hit, kind)
    return out


def slides(elements: DataFrame) -> DataFrame:
    """One row per slide: title, lead, body lines, cards, counts; needs the columns of an element table.

    Where no element is a card, two or more boxes with text are the cards; if
    the table has their heights (``h``), only if the tallest is at most
    CARD_RATIO times the lowest.
    """
    filled = F.filter(F.transform("lines", tx.strip), lambda x: x != "")
    e = elements.select(*KEY, "slide_title", "layout", "el_no", "type", "role", filled.alias("lines"), "src", "alt", "cells", "header_rows", (F.col("h") if "h" in elements.columns else F.lit(None).cast("double")).alias("h"))
    item = F.struct("el_no", "type", "role", "lines", "src", "alt", "cells", "header_rows", "h")
    g = e.groupBy(*KEY).agg(F.first("slide_title").alias("slide_title"), F.first("layout").alias("layout"), F.array_sort(F.collect_list(item)).alias("els"))
    pick = lambda test: F.filter("els", test)
    text_of = lambda els: F.flatten(F.transform(els, lambda x: x["lines"]))
    lead = F.get(pick(lambda x: F.coalesce(x["role"].isin("subtitle", "caption"), F.lit(False)) & (F.size(x["lines"]) == 1)), F.lit(0))
    g = g.withColumn("lead_no", lead["el_no"]).withColumn("lead", F.get(lead["lines"], F.lit(0)))
    cards = pick(lambda x: F.coalesce(x["role"] == "card", F.lit(False)))
    boxes = pick(lambda x: (x["type"] == "shape") & (F.size(x["lines"]) > 0))
    heights = F.transform(boxes, lambda x: F.coalesce(x["h"], F.lit(0.0)))
    alike = (F.array_min(heights) == 0) | (F.array_max(heights) <= CARD_RATIO * F.array_min(heights))
    g = g.withColumn("cards", F.when(F.size(cards) > 0, cards).when((F.size(boxes) >= 2) & alike, boxes).otherwise(F.slice(boxes, 1, 0)))
    body = pick(lambda x: (x["type"] == "text") & ~F.coalesce(x["role"] == "title", F.lit(False)) & ~F.coalesce(x["el_no"] == F.col("lead_no"), F.lit(False)))
    titled = F.get(text_of(pick(lambda x: F.coalesce(x["role"] == "title", F.lit(False)))), F.lit(0))
    any_text = F.substring(F.get(text_of(F.col("els")), F.lit(0)), 1, 40)
    title = F.coalesce(F.nullif(F.col("slide_title"), F.lit("")), titled, any_text, F.concat(F.lit("スライド "), F.col("slide_no").cast("string")))
    return g.select(
        *KEY, "layout", title.alias("title"), "lead", text_of(body).alias("body"), "cards", plain_text(text_of(F.col("els"))).alias("all_text"),
        F.size(pick(lambda x: x["type"] == "table")).alias("n_tables"), F.size(pick(lambda x: x["type"] == "image")).alias("n_images"),
        F.get(F.transform(pick(lambda x: x["type"] == "diagram"), lambda x: F.get(x["lines"], F.lit(0))), F.lit(0)).alias("diagram"),
        F.get(pick(lambda x: x["type"] == "table"), F.lit(0)).alias("table"), F.transform(pick(lambda x: x["type"] == "image"), lambda x: F.struct(x["src"].alias("src"), x["alt"].alias("alt"))).alias("images"),
    )


def classified(slide_rows: DataFrame) -> DataFrame:
    """Slides with ``kind`` and ``reason``; the first rule that applies decides."""
    lines_of = lambda c: F.array_join(c["lines"], " ")
    steps = F.size(F.filter("cards", lambda c: lines_of(c).rlike(STEP)))
    flow = F.col("all_text").rlike(ARROW) | (steps >= 2)
    in_cards = F.array_join(F.flatten(F.transform("cards", lambda c: c["lines"])), " ")
    n_cards, n_body = F.size("cards"), F.size("body")
    years = F.size(F.filter("body", lambda x: x.rlike(YEAR)))
    numbers = F.size(F.filter("body", lambda x: x.rlike(NUMBER)))
    word = word_kind(F.col("title"))
    rules = [
        (F.col("diagram").isNotNull(), F.when(F.col("diagram").isin(*KINDS), F.col("diagram")).otherwise("cards"), "diagram"),
        (word.isNotNull(), word, "word in title"),
        (F.col("n_tables") > 0, F.lit("table"), "table"),
        ((n_cards > 0) & flow, F.lit("flow"), "cards with arrows or numbers"),
        ((n_cards == 2) & in_cards.rlike(COMPARE), F.lit("compare"), "two cards with opposed words"),
        (n_cards > 0, F.lit("cards"), "cards"),
        (years >= 2, F.lit("timeline"), "years in the body"),
        ((numbers >= 2) & (numbers >= n_body * 0.5), F.lit("kpi"), "numbers with units"),
        ((F.col("n_images") > 0) & (n_body > 0), F.lit("image_text"), "image and body"),
        (F.col("n_images") > 0, F.lit("image"), "image"),
        (n_body > 0, F.lit("bullets"), "body"),
    ]
    kind, reason = F, F
    for test, k, why in rules:
        kind, reason = kind.when(test, k), reason.when(test, F.lit(why))
    return slide_rows.withColumn("kind", kind.otherwise("title_only")).withColumn("reason", reason.otherwise("nothing but a title"))


def overridden(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Kinds replaced by those of the overrides (page_id, slide_no, kind), where they are kinds."""
    o = overrides.where(F.col("kind").isin(*KINDS)).select(*KEY, F.col("kind").alias("set_kind"))
    return rows.join(o, KEY, "left").withColumn("reason", F.when(F.col("set_kind").isNotNull(), "set by hand").otherwise(F.col("reason"))).withColumn("kind", F.coalesce("set_kind", "kind")).drop("set_kind")


def items(rows: DataFrame) -> DataFrame:
    """(page_id, slide_no, nth, heading, body) of the cards: first line and the others."""
    c = rows.select(*KEY, F.posexplode("cards").alias("pos", "c")).where(F.size("c.lines") > 0)
    return c.select(*KEY, (F.col("pos") + 1).alias("nth"), F.get("c.lines", F.lit(0)).alias("heading"), F.array_join(F.slice("c.lines", F.lit(2), F.size("c.lines")), " ").alias("body"))


def title_and_text(c: Column) -> Column:
    """``title: text`` in its two parts, for either kind of colon."""
    parts = F.split(c, r"\s*[:：]\s*", 2)
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("title"), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit("")).alias("text"))


def fitting(rows: DataFrame, text_col: str, key: list[str], order: list, most: int = 12_000) -> DataFrame:
    """The first rows of each key whose texts together, a line end behind each, stay within the limit."""
    used = F.sum(F.length(text_col) + 1).over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("used", used).where(F.col("used") <= most)
