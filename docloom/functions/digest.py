"""What a reader wants to know of a document, by rules: headings, dates, repeats, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text as tx

MAX_HEADING, MIN_REPEATED, MOST_REPEATED, MOST_DATES, MOST_QUESTIONS = 60, 30, 20, 20, 12

# How headings, dates and references are written.
MARKER = r"^(#{1,4})(?U:\s)+(.*\S)(?U:\s)*$"
NUMBERED = [
    (r"(?U)^第\s*([0-9０-９一二三四五六七八九十]+)\s*[章編]\s*(.*)$", 1),
    (r"(?U)^第\s*([0-9０-９一二三四五六七八九十]+)\s*節\s*(.*)$", 2),
    (r"(?U)^([0-9]+[.．][0-9]+[.．][0-9]+)[.．]?\s*(\S.*)$", 3),
    (r"(?U)^([0-9]+[.．][0-9]+)[.．]?\s*(\S.*)$", 2),
    (r"(?U)^([0-9]+)[.．]\s*(\S.*)$", 1),
    (r"(?U)^[（(]\s*([0-9]+)\s*[）)]\s*(\S.*)$", 3),
]
#: What every heading of these kinds begins with.
MAY_BE_HEADING = r"^(#{1,4}(?U:\s)|第|[0-9]+[.．]|[（(])"
DATES = [
    r"(?U)(?:19|20)\d{2}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?",
    r"(?U)(?:令和|平成)\s*[0-9０-９元]{1,2}\s*年\s*\d{1,2}\s*月",
    r"(?U)(?:19|20)\d{2}[/-]\d{1,2}(?:[/-]\d{1,2})?",
    r"(?U)(?:Rev|Ver|ver|版数)[.．]?\s*[0-9]+(?:\.[0-9]+)?",
    r"(?U)第\s*[0-9]+\s*版",
]
ERA = r"(?U)(令和|平成)\s*([0-9０-９元]{1,2})\s*年"
REFERENCE = r"(?U)(別紙|別表|附属書|付録|様式|参考資料|図|表)\s*([0-9０-９A-Za-z]{1,3})"
HINTS = "参照|参考|による|のとおり|別途|添付"
MACHINE_TITLES = "^(Page|Slide|Sheet:|ZIP|Notes|XML Text|埋め込みオブジェクト)"
QUESTIONS = [
    ("(手順|方法|フロー|作業|進め方)$", "は？（具体的な手順）"),
    ("(基準|条件|範囲|要件|仕様)$", "はどう決まっている？"),
    ("(注意|禁止|リスク|安全)", "として気をつけることは？"),
]
OTHER_QUESTION = "について教えて"


def headings(c: Column) -> Column:
    """Array of (level, title, line): marker lines, else numbered lines that don't end a sentence.

    Of the numbering patterns the first that matches decides, even if it
    leaves no title and so gives no heading.
    """

    kind = "struct<level:int,title:string,line:int>"
    nothing = F.lit(None).cast(kind)
    #: lines that can be headings at all are few; only they meet the patterns
    lines = F.transform(tx.split_lines(c), lambda x, i: F.struct(tx.strip(x).alias("text"), i.cast("int").alias("line")))
    maybe = F.filter(lines, lambda x: (F.length(x["text"]) <= MAX_HEADING) & x["text"].rlike(MAY_BE_HEADING))

    def of(x: Column) -> Column:
        line = x["text"]
        as_struct = lambda level, title: F.struct(level.cast("int").alias("level"), title.alias("title"), x["line"].alias("line"))
        found = F.when(line.rlike(MARKER), as_struct(F.length(F.regexp_extract(line, MARKER, 1)), F.regexp_extract(line, MARKER, 2))).when(line.endswith("。"), nothing)
        for pattern, level in NUMBERED:
            title = tx.strip(F.regexp_extract(line, pattern, 2))
            number = tx.fold_digits(F.regexp_extract(line, pattern, 1))
            found = found.when(line.rlike(pattern), F.when(title != "", as_struct(F.lit(level), F.concat(number, F.lit(" "), title))))
        return found.otherwise(nothing)

    return F.filter(F.transform(maybe, of), lambda h: h.isNotNull())


def date_mentions(c: Column) -> Column:
    """Distinct mentions, pattern by pattern and then by place (not cut to the first ones)."""
    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(c, F.lit(f"({p})"), F.lit(1)) for p in DATES]), tx.strip))


def year_of_mention(m: Column) -> Column:
    """The western year in a mention, else the one its era and year give (a first year counts as 1)."""
    plain = F.regexp_extract(m, "(?U)((?:19|20)\\d{2})", 1)
    era, n = F.regexp_extract(m, ERA, 1), tx.fold_digits(F.regexp_extract(m, ERA, 2))
    n = F.when(n == "元", 1).otherwise(n.try_cast("int"))
    return F.when(plain != "", tx.fold_digits(plain).try_cast("int")).when(era == "令和", 2018 + n).when(era == "平成", 1988 + n)


def year_of_mentions(mentions: Column) -> Column:
    return F.array_max(F.transform(mentions, year_of_mention))


def newest_year(c: Column) -> Column:
    return year_of_mentions(date_mentions(c))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n, rank): long lines that occur more than once in a document, most frequent first, then first seen."""
    long = lambda x: (F.length(x) >= MIN_REPEATED) & ~x.startswith("#")
    stripped = F.transform(tx.split_lines(F.col(text_col)), tx.strip)
    #: only documents with a line that repeats give rows, so that texts are not shuffled as lines
    twice = lambda x: F.when(F.size(F.array_distinct(F.filter(x, long))) < F.size(F.filter(x, long)), x)
    lines = docs.select(F.col(id_col), F.posexplode(tx.let(stripped, twice)).alias("pos", "line"))
    counted = lines.where(long(F.col("line"))).groupBy(id_col, "line").agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")
    rank = F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= MOST_REPEATED).select(id_col, "line", "n", "rank")


def broken_references(c: Column) -> Column:
    """Labels that a line refers to and none begins with, sorted.

    A label counts as referred to if a hint word starts within 12 characters
    behind it, and as defined at the beginning of a line without such a hint.
    """
    mention = "(?:別紙|別表|附属書|付録|様式|参考資料|図|表)\\s*[0-9０-９A-Za-z]{1,3}"

    def found(line: Column) -> Column:
        #: the line in parts that each end with a mention; their lengths tell where its tail begins
        parts = F.regexp_extract_all(line, F.lit(f"(?Us)(.*?{mention})"), F.lit(1))
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
        alone = lambda p: F.regexp_extract(p, f"(?Us)({mention})\\z", 1)
        label = lambda p: F.concat(F.regexp_extract(alone(p), REFERENCE, 1), tx.fold_digits(F.regexp_extract(alone(p), REFERENCE, 2)))
        return F.zip_with(parts, F.slice(ends, F.lit(2), F.size(parts)), lambda p, e: F.struct(label(p).alias("label"), F.substr(line, e + 1, F.lit(12)).alias("tail"), (F.length(alone(p)) == e).alias("first")))

    some = F.filter(tx.filled_lines(c), lambda x: x.rlike(REFERENCE))
    mentions = F.flatten(F.transform(some, found))
    hinted = lambda m: m["tail"].rlike(HINTS)
    referred = F.transform(F.filter(mentions, hinted), lambda m: m["label"])
    defined = F.transform(F.filter(mentions, lambda m: m["first"] & ~hinted(m)), lambda m: m["label"])
    return F.array_sort(F.array_distinct(F.array_except(referred, defined)))


def average_sentence(c: Column, stop: str = "。") -> Column:
    """Mean length of what stands between sentence ends and line ends, without heading lines; 0 for none."""
    body = F.array_join(F.filter(tx.split_lines(c), lambda x: ~x.startswith("#")), "\n")
    parts = F.filter(F.transform(F.split(body, f"[{stop}\n]"), tx.strip), lambda s: s != "")
    mean = lambda p: F.when(F.size(p) == 0, F.lit(0.0)).otherwise(F.aggregate(p, F.lit(0), lambda acc, s: acc + F.length(s)) / F.size(p))
    return tx.let(parts, mean)


def readability(c: Column) -> Column:
    """A label for a mean sentence length."""
    return F.when(c <= 0, "unknown").when(c < 35, "easy").when(c < 55, "normal").otherwise("hard")


def is_stale(year: Column, today: Column, years: int = 3) -> Column:
    return F.coalesce(F.year(today) - year >= years, F.lit(False))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with all of the above; repeated lines as an array of (line, n)."""
    c = F.col(text_col)
    repeats = repeated_lines(docs, id_col, text_col).groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line", "n"))), lambda r: F.struct(r["line"].alias("line"), r["n"].alias("n"))).alias("repeated_lines"))
    rows = docs.select(
        id_col, headings(c).alias("headings"), date_mentions(c).alias("mentions"), broken_references(c).alias("broken_references"),
        average_sentence(c).alias("avg_sentence_length"), F.length(c).alias("char_count"), F.size(tx.split_lines(c)).alias("line_count"),
    )
    rows = rows.select(
        id_col, "headings", F.slice("mentions", 1, MOST_DATES).alias("date_mentions"), year_of_mentions(F.col("mentions")).alias("newest_year"), "broken_references", "avg_sentence_length", "char_count", "line_count",
    )
    return rows.join(repeats, id_col, "left").withColumn("repeated_lines", F.coalesce("repeated_lines", F.array().cast("array<struct<line:string,n:bigint>>")))


def questions(docs: DataFrame, id_col: str = "doc_id", headings_col: str = "headings") -> DataFrame:
    """(id, rank, question, title) that the headings of a document seem to answer."""
    h = docs.select(id_col, F.posexplode(headings_col).alias("pos", "h")).select(id_col, "pos", tx.strip(F.col("h.title")).alias("title"))
    core = tx.strip(F.regexp_replace("title", r"(?U)^[0-9.]+\s*", ""))
    h = h.where(~F.col("title").rlike(MACHINE_TITLES)).withColumn("core", core).where(F.length("core") >= 3)
    first = F.row_number().over(W.partitionBy(id_col, "core").orderBy("pos"))
    h = h.withColumn("nth", first).where("nth = 1")
    ending = reduce(lambda acc, q: acc.when(F.col("core").rlike(q[0]), F.lit(q[1])), QUESTIONS[1:], F.when(F.col("core").rlike(QUESTIONS[0][0]), F.lit(QUESTIONS[0][1]))).otherwise(F.lit(OTHER_QUESTION))
    rank = F.row_number().over(W.partitionBy(id_col).orderBy("pos"))
    return h.withColumn("rank", rank).where(F.col("rank") <= MOST_QUESTIONS).select(id_col, "rank", F.concat("core", ending).alias("question"), "title")
