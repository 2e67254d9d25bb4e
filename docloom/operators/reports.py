"""Reports as rows of lines, so that any sink can write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import digest as dg
from ..functions import text as tx
from . import health

SHOWN = 100
COPY_CHARS = 20_000


def coverage_report(outcomes: DataFrame, findings: DataFrame, groups: DataFrame) -> DataFrame:
    """(section, nth, line): counts by status, unit coverage, files with trouble, sensitive kinds, duplicate groups."""
    line = lambda section, c, order: (lambda df: df.select(F.lit(section).alias("section"), c.alias("line"), *[o.alias(f"o{i}") for i, o in enumerate(order)]))
    status = line("status", F.concat_ws(": ", "status", F.col("n").cast("string")), [F.col("status"), F.lit("")])(health.status_counts(outcomes))
    share = line("coverage", F.format_string("%d of %d units", "units_ok", "units_total"), [F.lit(""), F.lit("")])(health.coverage(outcomes).where("units_total > 0"))
    trouble = line("trouble", F.concat_ws(" - ", "relative_path", "status", F.nullif("reason", F.lit(""))), [F.col("status"), F.col("relative_path")])(outcomes.where("status not in ('ok', 'dedupe_excluded')"))
    found = line("sensitive", F.concat_ws(": ", "kind", F.col("hits").cast("string")), [F.col("kind"), F.lit("")])(findings)
    twin = line("duplicates", F.concat(F.col("relative_path"), F.when(F.col("keep"), F.lit(" (kept)")).otherwise(F.lit(""))), [F.col("grp").cast("string"), F.col("relative_path")])(groups)
    every = status.unionByName(share).unionByName(trouble).unionByName(found).unionByName(twin)
    nth = F.row_number().over(W.partitionBy("section").orderBy("o0", "o1"))
    more = F.count("*").over(W.partitionBy("section")) - SHOWN
    cut = every.withColumn("nth", nth).withColumn("more", more).where(F.col("nth") <= SHOWN + 1)
    return cut.select("section", "nth", F.when(F.col("nth") > SHOWN, F.concat(F.lit("... "), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.col("line")).alias("line"))


def digest_page(name: Column, text: Column, headings: Column, newest_year: Column, mentions: Column, broken: Column, average: Column, today: Column) -> Column:
    """A document's digest as Markdown, with its first characters to copy."""
    heads = F.array_join(F.transform(headings, lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- "), h["title"])), "\n")
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n\n"), c))
    stale = F.when(dg.is_stale(newest_year, today), F.concat(F.lit("- newest year: "), newest_year.cast("string")))
    notes = F.concat_ws("\n", stale, F.when(F.size(broken) > 0, F.concat(F.lit("- missing: "), F.array_join(broken, ", "))), F.when(average >= 55, F.lit("- long sentences")))
    fenced = lambda body: tx.let(tx.code_fence(body), lambda fence: F.concat(F.lit("\n## Text\n\n"), fence, F.lit("text\n"), F.substring(body, 1, COPY_CHARS), F.lit("\n"), fence))
    return F.concat_ws("\n", F.concat(F.lit("# "), name), F.concat(F.lit("readability: "), dg.readability(average)), part("Contents", heads), part("Dates", F.array_join(F.slice(mentions, 1, dg.MOST_DATES), ", ")), part("Findings", notes), tx.let(tx.strip(text), fenced))


def markdown_sections(chunks: DataFrame) -> DataFrame:
    """(index, text, size): the section of each chunk record, its text fenced."""
    body = F.when(F.col("text") == "", F.lit(tx.NO_TEXT)).otherwise(F.col("text"))
    fence = tx.code_fence(body)
    head = F.format_string("## %s (%d/%d)\n- path: %s\n- size: %s\n", "file_name", "chunk_index", "chunk_count", "relative_path", "size_text")
    text = F.concat(head, fence, F.lit("text\n"), body, F.lit("\n"), fence, F.lit("\n"))
    return chunks.select("index", text.alias("text"), F.length(text).alias("size"))


#: Fixed value: what a file name must not hold.
UNSAFE = r'[\\/:*?"<>|\x00-\x1F]+'


def image_manifest(elements: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, slide_no, el_no, filename, alt, available) of the pictures that go along with a page's prompt, in the page's order by the numbers.

    The name is that of the page's own file, else of the source; a picture
    that is neither a file nor a data URI is not available.
    """
    src = F.coalesce("src", F.lit(""))
    inline = src.startswith("data:")
    name = F.coalesce(tx.base_name(F.col("asset")), F.when(inline, "").otherwise(tx.base_name(F.regexp_replace(src, "[?#].*$", ""))))
    return elements.where("type = 'image'").select(id_col, "slide_no", "el_no", name.alias("filename"), F.coalesce("alt", F.lit("")).alias("alt"), (inline | F.col("asset").isNotNull()).alias("available"))


def packed_images(manifest: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, file_name, slide_no, el_no) of the available pictures, one per safe name; of equal names the last stands."""
    named = F.when(F.col("filename") == "", F.concat(F.lit("image_"), F.col("slide_no").cast("string"), F.lit("_"), F.col("el_no").cast("string"), F.lit(".bin"))).otherwise(F.col("filename"))
    rows = manifest.where("available").select(id_col, F.regexp_replace(named, UNSAFE, "_").alias("file_name"), F.struct("slide_no", "el_no").alias("at"))
    return rows.groupBy(id_col, "file_name").agg(F.max("at").alias("at")).select(id_col, "file_name", "at.*")
