"""Each rule against a small restatement in plain Python, or against given pairs."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import calendar as cal
from docloom.functions import codec, color, digest, pii
from docloom.functions import text as tx
from docloom.operators import scenario

TEXTS = ["", " ", "a", "a\r\nb", "a\n\n\n\nb  c\t\td ", "　x　 y\x1c", "# H\nbody\n## I\nmore", "one\n\n two \n" * 30, "x" * 500, "a\x0bb\x0cc\x85d\n", "tail\n\n", "`a` ```b```` c"]


def values(spark, rows, *exprs, schema="c string"):
    return [tuple(r) for r in spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).select(*exprs).collect()]


def py_normal(t):
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t.replace("\r", "\n"))).strip()


def py_filled(t):
    return [x.strip() for x in t.splitlines() if x.strip()]


def py_cut(t, n):
    return t[:n] + "..." if len(t) > n else t


def test_text_rules(spark):
    c = F.col("c")
    got = values(spark, TEXTS, tx.normalize_text(c), tx.split_lines(c), tx.plain_summary(c), tx.one_line(c), tx.excerpt(c), tx.token_estimate(c))
    for t, row in zip(TEXTS, got):
        n = py_normal(t)
        summary = py_cut("\n".join(py_filled(n)[:20]), 1200) if n else tx.NO_TEXT
        assert row == (n, t.splitlines(), summary, py_cut(" / ".join(py_filled(t)), 160), py_cut(t, 300), max(1, round(len(t) / 1.4)) if t else 0)


def test_heading_summary(spark):
    lines = "\n".join(f"line {i} " + "x" * 90 for i in range(9))
    got = values(spark, ["# One\nbody\n##Two\n## Two\n" + lines, lines, ""], tx.heading_summary(F.col("c")))
    lead = "\n".join(f"line {i} " + "x" * 90 for i in range(4))
    assert got[0][0].startswith("見出し: One / Two\nbody\n##Two\nline 0 ")
    assert got[1][0] == "\n".join(f"line {i} " + "x" * 90 for i in range(5)) and lead in got[1][0] and got[2][0] == tx.NO_TEXT


def test_tail_fence_names(spark):
    assert values(spark, ["ab\ncd\nef", "abc", "\n\nx\n"], tx.line_tail(F.col("c"), 4), tx.line_tail(F.col("c"), 0)) == [("ef", ""), ("abc", ""), ("x", "")]
    assert values(spark, ["a", "```` x ``", "```"], tx.code_fence(F.col("c"))) == [("```",), ("`````",), ("````",)]
    paths = ["a/b.TXT", "b.txt", "a/.hidden", "a.b/c", 'x:"<y>|.pdf']
    got = values(spark, paths, tx.extension(F.col("c")), tx.group_key(F.col("c")), tx.clean_filename(F.col("c")), tx.is_same_or_child(F.col("c"), F.lit("a")))
    assert got == [(".txt", "a", "a_b.TXT", True), (".txt", "_root", "b.txt", False), ("", "a", "a_.hidden", True), ("", "a.b", "a.b_c", False), (".pdf", "_root", "x___y__.pdf", False)]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1 << 42), st.sampled_from([1152, 1024, 1023, 1048576 + 5243, (1 << 30) * 3])), min_size=50, max_size=50))
def test_format_size(sizes):
    from pyspark.sql import SparkSession

    def want(n):
        for k, unit in ((1 << 30, "GB"), (1 << 20, "MB"), (1 << 10, "KB")):
            if n >= k:
                return f"{n / k:.2f} {unit}"
        return f"{n} B"

    spark = SparkSession.getActiveSession()
    sizes = [*sizes, 2_147_483_643, 3_221_225_471, (1 << 40) - 1, (1 << 20) - 1]
    assert values(spark, sizes, tx.format_size(F.col("n")), schema="n long") == [(want(n),) for n in sizes]


def test_content_hash(spark):
    same = ["a\n## LastDiff\nx\n## LastDiff\ny\n## b\nGeneratedAt: 3\nc", "a\n## b\nc", "GeneratedAt: 9\na\n## b\nc\n"]
    assert len(set(values(spark, same, tx.content_hash(F.col("c"))))) == 1


def test_templates(spark):
    assert values(spark, ["{a} & {b} {zz}"], tx.fill_template(F.col("c"), {"a": F.lit(1), "b": F.lit("<x>")}), tx.escape_html(F.lit("<a b='1'>&\""))) == [("1 & <x> {zz}", "&lt;a b=&#39;1&#39;&gt;&amp;&quot;")]


# -- sensitive values ----------------------------------------------------------


PII = ["call 090-1234-5678 or mail a.b@c-d.org", "1234-5678-9012-3456 and 123456789012 and 1234567890123456", "3.14 lot 12345678 1-090-1234-5678", "1234-5678-9012", "１２３４５６７８９０１２", "secret x.y", ""]


def test_pii_agrees_with_regular_expressions(spark):
    own = pii.dictionary(["# no", "", "x.y", "regex:sec.et", "regex:(", " lot "])
    assert own == [re.escape("x.y"), "sec.et", "lot"]
    got = values(spark, PII, pii.scan(F.col("c"), own), pii.mask(F.col("c"), own), pii.mask_counts(F.col("c"), own))
    for t, (found, masked, counts) in zip(PII, got):
        want, replaced, text = {}, {}, t
        for kind, p in [*pii.BUILT_IN.items(), *(("dictionary", p) for p in own)]:
            n = len(list(re.finditer(p, t)))
            text, m = re.subn(p, pii.MASK, text)
            want |= {kind: want.get(kind, 0) + n} if n else {}
            replaced |= {kind: replaced.get(kind, 0) + m} if m else {}
        assert (found, masked, counts) == (want, text, replaced)
    rows = spark.createDataFrame([(t,) for t in PII], "text string")
    assert {r.text for r in pii.without_hits(rows, own=own).collect()} == {t for t in PII if not any(re.search(p, t) for p in [*pii.BUILT_IN.values(), *own])}
    total = {r.kind: r.hits for r in pii.merge_findings(rows.select(pii.scan(F.col("text")).alias("findings"))).collect()}
    assert total == {"card": 2, "my_number": 3, "phone": 1, "email": 1}


# -- digest ----------------------------------------------------------------------


MANUAL = """第1章 総則
1.1 適用設備
1.1.1. 範囲
別紙2参照のこと。表1による 別紙１
表1 一覧
平成元年4月 Rev. 1.2 2019年4月版 令和３年5月 2018/03 2018/03 第 3 版
# Page 1
同じ行がここに二回あり、三十文字を超えるように書かれている行なのです。
同じ行がここに二回あり、三十文字を超えるように書かれている行なのです。
3.
(2) 点検手順
4. これは文です。
第5節 注意事項
6. 判定基準"""


def test_digest(spark):
    docs = spark.createDataFrame([(1, MANUAL), (2, ""), (3, "No. Just. Text")], "doc_id long, text string")
    rows = {r.doc_id: r for r in digest.digest(docs).collect()}
    r = rows[1]
    assert [(h.level, h.title, h.line) for h in r.headings] == [(1, "1 総則", 0), (2, "1.1 適用設備", 1), (3, "1.1.1 範囲", 2), (1, "Page 1", 6), (3, "2 点検手順", 10), (2, "5 注意事項", 12), (1, "6 判定基準", 13)]
    assert r.date_mentions == ["2019年4月", "平成元年4月", "令和３年5月", "2018/03", "Rev. 1.2", "第 3 版"] and r.newest_year == 2021
    assert r.broken_references == ["別紙2"] and [(x.line[:4], x.n) for x in r.repeated_lines] == [("同じ行が", 2)]
    assert r.line_count == 14 and r.char_count == len(MANUAL)
    assert rows[2].headings == [] and rows[2].avg_sentence_length == 0 and rows[3].broken_references == []
    asked = digest.questions(digest.digest(docs)).orderBy("rank").collect()
    assert [q.question for q in asked] == ["適用設備について教えて", "点検手順は？（具体的な手順）", "注意事項として気をつけることは？", "判定基準はどう決まっている？"]


def test_average_and_labels(spark):
    got = values(spark, ["# h\nab。cde\n\nf", "", "。。"], digest.average_sentence(F.col("c")))
    assert got == [(2.0,), (0.0,), (0.0,)]
    labels = values(spark, [0.0, 34.9, 35.0, 54.9, 55.0], digest.readability(F.col("x")), schema="x double")
    assert [x[0] for x in labels] == ["unknown", "easy", "normal", "normal", "hard"]
    years = values(spark, [2020, 2021, None], digest.is_stale(F.col("y"), F.lit(dt.date(2023, 5, 1))), schema="y int")
    assert years == [(True,), (False,), (False,)]


# -- colours, days, letters ---------------------------------------------------------


def test_colors(spark):
    c = F.col("c")
    rows = ["rgb(11, 61,145)", "rgba(1,2,3,0)", "rgba(1,2,300,0.5)", "#abc", "#a1B2c3", " #FFFFFF ", "red", None, "#abcd"]
    assert [x[0] for x in values(spark, rows, color.css_color(c))] == ["#0B3D91", None, "#0102FF", "#AABBCC", "#A1B2C3", "#FFFFFF", None, None, None]
    assert [x[0] for x in values(spark, ["16px", "10.5px", "2em", None], color.px_to_pt(c))] == [12.0, 7.9, None, None]
    assert values(spark, ["#000000", "#FFFFFF", "#808080"], color.is_dark(c), color.brighter(c, 0.5), color.brighter(c, -0.5)) == [(True, "#808080", "#000000"), (False, "#FFFFFF", "#808080"), (0.299 * 128 + 0.587 * 128 + 0.114 * 128 < 128, "#C0C0C0", "#404040")]
    #: 299 * 102 + 587 * 136 + 114 * 155 is 128,000, and doubles make less of it
    assert values(spark, ["#66889B", "#26B656", "#66889A"], color.is_dark(c, exact=True)) == [(False,), (False,), (True,)]
    style = values(spark, ["color: red; background: url(x) #abc; font-size:12px; margin: 3px; color: #111; text-align:", ""], color.inline_style(c))
    assert style == [({"background-color": "#abc", "font-size": "12px", "color": "#111"},), ({},)]


def test_calendar(spark):
    day = F.col("d")
    rows = [dt.date(2024, 11, 30), dt.date(2024, 12, 1), dt.date(2024, 12, 28), dt.date(2024, 12, 31), dt.date(2025, 1, 1)]
    got = values(spark, rows, cal.phase(day, F.lit(2024)), cal.days_left(day, F.lit(2024)), cal.weighted_days(day, F.lit(2024)), schema="d date")
    assert got == [("prep", 32, 1 + 27 * 2 + 4 * 7), ("dec", 31, 27 * 2 + 28), ("final", 4, 28), ("final", 1, 7), ("over", 0, 0)]
    jst = values(spark, [dt.datetime(2024, 1, 1, 14, 59), dt.datetime(2024, 1, 1, 15, 0)], cal.jst_day(F.col("t")), schema="t timestamp_ntz")
    assert jst == [(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)]
    assert [x[0] for x in values(spark, ["a -1,234.50kg 7", "none", "3", None], cal.number_in(F.col("c")))] == [-1234.5, None, 3.0, None]
    dates = ["2024-3-9", "２０２４年３月９日", "3/9", "6/30", "2024/2/30", "13/1", "soon", "2/29"]
    want = [dt.date(2024, 3, 9), dt.date(2024, 3, 9), dt.date(2025, 3, 9), dt.date(2024, 6, 30), None, None, None, None]
    assert [x[0] for x in values(spark, dates, cal.date_in(F.col("c"), F.lit(dt.date(2024, 5, 1))))] == want
    assert [x[0] for x in values(spark, [0, 1, 2, 3, 10, 99], cal.title_for(F.col("n")), schema="n int")] == ["たびびと", "みならい", "みならい", "ぼうけんしゃ", "人生最高の余暇", "人生最高の余暇"]


def test_letters(spark):
    raw = [bytes(range(n)) for n in range(71)]
    df = spark.createDataFrame([(x,) for x in raw], "b binary").select("b", codec.to_letters(F.col("b")).alias("t"))
    for r in df.select("b", "t", codec.from_letters(F.col("t")).alias("back")).collect():
        assert r.back == r.b and len(r.t) == -(-len(r.b) * 8 // 6) and set(r.t) <= set(codec.LETTERS)
    assert [x[0] for x in values(spark, ["あ", "ああ", "あう", "ax", ""], codec.from_letters(F.col("c")))] == [None, b"\0", None, None, b""]
    lines = spark.createDataFrame([(1, 1, "うえ"), (1, 0, "あ い"), (2, 0, "あ"), (2, 0, "あ"), (3, 1, "あ")], "slot int, line int, data string")
    assert {(r.slot, r.data, r.ok) for r in codec.read_card(lines).collect()} == {(1, "あいうえ", True), (2, "ああ", False), (3, "あ", False)}
    points = spark.createDataFrame([("abcz",), ("日",), ("é𠮷",)], "text string")
    assert {tuple(r) for r in codec.code_ranges(codec.used_characters(points)).collect()} == {(97, 99), (122, 122), (233, 233), (0x65E5, 0x65E5), (0x20BB7, 0x20BB7)}


def test_scenario_texts(spark):
    n = F.col("x")
    assert [x[0] for x in values(spark, [0.26, 45.0, 999.0, 2385.0, 1e7, 12345678.0, 4.5e11, 3e16], scenario.volume_text(n), schema="x double")] == ["0.26 mL", "45 mL", "999 mL", "2.38 L", "1 万 L", "1.23 万 L", "4.50 億 L", "30 兆 L"]
    assert [x[0] for x in values(spark, [5.0, 1234.0, 25000.0, 123456789.0], scenario.count_text(n), schema="x double")] == ["5", "1,234", "2.5万", "1.2億"]
    assert [x[0] for x in values(spark, [150.4, 3.0, 12.34, 0.126, 0.0015], scenario.times_text(n), schema="x double")] == ["150", "3", "12.3", "0.13", "0.002"]
    assert [x[0] for x in values(spark, [0, 61_000, 3_661_999, -5], scenario.duration_text(n), schema="x long")] == ["00:00", "01:01", "1:01:01", "00:00"]
    assert values(spark, [95], scenario.catch_up(n, F.lit(10), 30), schema="x long") == [((2, 70),)]
    p = values(spark, [1.0, 10.0, 1000.0], scenario.log_position(n, 1.0, 1000.0), scenario.from_log_position(scenario.log_position(n, 1.0, 1000.0), 1.0, 1000.0), schema="x double")
    assert [round(a, 6) for a, _ in p] == [0.0, 0.333333, 1.0] and [b for _, b in p] == pytest.approx([1.0, 10.0, 1000.0])
