import base64
import datetime as dt
import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import chunking, health, packing, publish, scenario, search, similarity, snapshot, streaks, structure
from docloom.operators.components import components
from docloom.operators.ordering import numbered
from docloom.sources import html

# -- chunks ---------------------------------------------------------------------

LINES = st.lists(st.text("ab #\n", max_size=40), max_size=30).map("\n".join)


@settings(max_examples=150, deadline=None)
@given(LINES, st.integers(5, 60))
def test_line_chunks_keep_everything(text, most):
    chunks = chunking.by_lines(text, most)
    assert all(len(c) <= most for c in chunks) and chunks
    assert "".join(chunks).replace("\n", "") == text.replace("\n", "")
    assert chunking.by_lines("", most) == [""]


@settings(max_examples=150, deadline=None)
@given(LINES, st.integers(5, 60), st.sampled_from([0.0, 0.2]))
def test_section_chunks(text, most, overlap):
    chunks = chunking.by_sections(text, most, overlap)
    assert all(len(c) <= most for c in chunks) and chunks
    if not overlap:
        assert "".join(chunks).replace("\n", "") == text.replace("\n", "")


def test_chunk_pairs(spark):
    assert [len(c) for c in chunking.by_lines("x" * 250, 100)] == [100, 100, 50]
    assert len(chunking.by_lines("\n".join(["short line"] * 20), 100)) == 3
    sections = "\n".join(f"# S{i}\n" + "text " * 40 for i in range(3))
    assert [c[:4] for c in chunking.by_sections(sections, 250, 0.0)] == ["# S0", "# S1", "# S2"]
    paragraphs = "\n\n".join(f"p{i} " + "word " * 20 for i in range(12))
    chunks = chunking.by_sections(paragraphs, 300, 0.2)
    assert all(b.split("\n")[0] in a for a, b in zip(chunks, chunks[1:]))
    docs = spark.createDataFrame([(1, "a\r\n\r\n\r\nb"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.chunk_index, r.chunk_count, r.text) for r in chunking.chunk(docs).collect()}
    assert got == {(1, 1, 1, "a\n\nb"), (2, 1, 1, "")}


# -- parts ------------------------------------------------------------------------


def parts_of(spark, rows, *args):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(rows)], "grp string, ord long, size long")
    return [r.part for r in packing.pack(df, *args).orderBy("ord").collect()]


def test_parts(spark):
    assert parts_of(spark, [20_000] * 2) == [1, 2]
    many = parts_of(spark, [20_000] * 40)
    assert many[:19] == list(range(1, 20)) and many[19:] == [None] * 21
    assert parts_of(spark, [18, 18, 11, 11], "sequential", 30, 19) == [1, 2, 2, 3]
    assert parts_of(spark, [18, 18, 11, 11], "bestfit", 30, 19) == [1, 2, 1, 2]
    assert parts_of(spark, [50, 25, 10, 5], "sequential", 30, 2) == [1, 2, None, 2]
    assert parts_of(spark, [40, 40, 10], "bestfit", 30, 1) == [1, None, None]
    assert parts_of(spark, [50, 60, 10], "rollover", 100, 20) == [1, 2, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 5))
def test_best_fit_choice(sizes, limit):
    used = [0]
    bins = packing.BestFit(40, limit)
    for s in sizes:
        rooms = {i: 40 - u for i, u in enumerate(used) if u == 0 or u + s <= 40}
        want = min(rooms, key=lambda i: (rooms[i], i)) if rooms else (len(used) if len(used) < limit else None)
        if want == len(used):
            used.append(0)
        if want is not None:
            used[want] += s
        assert bins.place(s) == (None if want is None else want + 1)


# -- similarity ---------------------------------------------------------------------


@pytest.mark.parametrize("block, shared", [(1000, 8), (5, 8), (3, 1)])
def test_similar_pairs_against_all_pairs(spark, monkeypatch, block, shared):
    """Also where values are so crowded that they are cut into parts."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "SHARED", shared)
    rng = random.Random(2)
    base = " ".join(f"word{rng.randrange(60)}" for _ in range(120))
    texts = [base, base + " one more line", base.replace("word1 ", "WORD1  "), base[:-40], "xyz " * 60, "", "  ", "abc", "ABC ", base + base[::-1]]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 80))) for _ in range(25)]
    texts += [t + "!" for t in texts[12:20]]
    texts += [base + f" tail {rng.randrange(1000)}" * rng.randrange(1, 4) for _ in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = similarity.signatures(docs)
    s = {i: (similarity.folded(t), similarity.sketch_of(similarity.folded(t))) for i, t in enumerate(texts)}

    def estimate(a, b):
        union = sorted(set(a) | set(b))[: similarity.SKETCH]
        return sum(h in a and h in b for h in map(int, union)) / len(union) if union else 0

    first = {}
    for i, (t, _) in s.items():
        first.setdefault(t, i)
    want, links = {}, []
    for i, j in itertools.combinations(s, 2):
        a, b = s[i][0], s[j][0]
        if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.81:
            continue
        e = 1.0 if a == b else estimate(s[i][1], s[j][1])
        if e >= 0.9:
            links.append((i, j))
            if first[a] == i and first[b] == j:
                want[i, j] = e
    got = {(r.a, r.b): r.similarity for r in similarity.similar_pairs(signed).collect()}
    assert got == pytest.approx(want) and len(want) >= 3
    at = {i: i for i in s}
    for _ in s:
        for i, j in links:
            at[i] = at[j] = min(at[i], at[j])
    sizes = defaultdict(int)
    for c in at.values():
        sizes[c] += 1
    groups = {r.doc_id: r.grp for r in similarity.similar_groups(signed).collect()}
    assert groups == {i: c for i, c in at.items() if sizes[c] > 1}


def test_keep_latest_takes_the_last_path_of_equal_times(spark):
    rows = spark.createDataFrame([("g", 1, "a"), ("g", 2, "b"), ("g", 2, "C")], "grp string, t int, p string")
    assert {r.p for r in similarity.keep_latest(rows, "grp", "t", "p").where("keep").collect()} == {"C"}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    at = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in at.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x int").repartition(5)
    assert {(r.x, r.nth) for r in numbered(rows, [-F.col("x")]).collect()} == {(x, 101 - x) for x in range(101)}


# -- runs, health, gate, search -------------------------------------------------------


def test_runs(spark):
    inventory = spark.createDataFrame([(1, "a", 1, 1.0), (1, "b", 1, 1.0), (3, "a", 2, 1.0), (3, "c", 1, 1.0)], "run_id int, path string, size int, mtime double")
    assert {tuple(r) for r in snapshot.diff_of_runs(inventory, 3).collect()} == {("a", "changed"), ("b", "removed"), ("c", "added")}
    assert snapshot.diff_of_runs(inventory, 1).count() == 0
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 0), ("c", 2)], "k string, v int")
    assert {tuple(r) for r in snapshot.merged(old, new, "k", "v").collect()} == {("a", 1), ("b", 0), ("c", 2)}


def test_health(spark):
    today = F.lit(dt.date(2024, 6, 1))
    rows = [("ok", dt.datetime(2024, 1, 1)), ("error", dt.datetime(2022, 1, 1)), ("empty", dt.datetime(2010, 1, 1)), ("error", None)]
    got = health.health_score(spark.createDataFrame(rows, "status string, modified timestamp"), today, F.lit(1), F.lit(2), F.lit(0))
    r = got.first()
    assert (r.readable, r.freshness, r.uniqueness, r.capacity, r.safety, r.total, r.grade) == (10, 13, 11, 0, 10, 44, "D")
    clean = health.health_score(spark.createDataFrame([("ok", dt.datetime(2024, 5, 1))] * 3, "status string, modified timestamp"), today, F.lit(0), F.lit(0), F.lit(0)).first()
    assert (clean.total, clean.grade) == (100, "A")
    assert [x.part for x in health.todo(got).collect()] == ["readable", "capacity", "freshness", "uniqueness"]
    assert health.health_score(spark.createDataFrame([], "status string, modified timestamp"), today, F.lit(0), F.lit(0), F.lit(0)).first().total is not None
    assert [tuple(x) for x in health.first_rows(spark.range(5), ["id"], 2).collect()] == [(0, 3), (1, 3)]


def test_gate(spark):
    rows = [(True, True, False, 9, 0), (False, True, True, 9, 9), (False, False, False, 9, 9), (False, False, True, None, 0), (False, False, True, 9, 0), (False, False, True, 10, 4), (False, False, True, 10, 5), (False, False, True, 0, 0)]
    df = spark.createDataFrame(rows, "force boolean, stopped boolean, had boolean, previous int, new int")
    got = publish.decide(df, F.col("force"), F.col("stopped"), F.col("had"), F.col("previous"), F.col("new")).collect()
    assert [r.reason for r in got] == ["forced", "hold: stopped", "hold: no source", "first run", "hold: no chunks", "hold: too few chunks", "ok", "ok"]
    assert [r.publish for r in got] == [True, False, False, True, False, False, True, True]
    index = spark.createDataFrame([("A: 1\nSourceChunkCount: 12\nB",), ("SourceChunkCount: 3",), ("x",)], "text string")
    assert publish.published_chunks(index).first()[0] == 15 and publish.published_chunks(index.where("text = 'x'")).first()[0] is None


def test_search(spark):
    docs = spark.createDataFrame([(1, "x" * 100 + "\nThe Needle is here" + "y" * 300), (2, "needle only"), (3, "HERE is a needle")], "doc_id long, text string")
    got = search.by_content(docs, "needle HERE").collect()
    assert [r.doc_id for r in got] == [1, 3] and got[0].excerpt == "x" * 75 + " / The Needle is here" + "y" * 146 and got[1].excerpt == "HERE is a needle"
    page = docs.select(search.page(F.col("text"), 0, 5).alias("p")).where("p.total = 11").first().p
    assert (page.text, page.total, page.next) == ("needl", 11, 5)
    with pytest.raises(ValueError):
        search.by_content(docs, " ")


# -- days and quests -------------------------------------------------------------------


def test_streaks(spark):
    rng = random.Random(1)
    today = dt.date(2024, 5, 20)
    rows = [(u, today - dt.timedelta(days=rng.randrange(-2, 12))) for u in range(30) for _ in range(rng.randrange(1, 14))]
    days = spark.createDataFrame(rows, "u int, day date")
    have = defaultdict(set)
    for u, d in rows:
        have[u].add(d)

    def want(s):
        d = today if today in s else today - dt.timedelta(days=1)
        n = 0
        while d in s:
            n, d = n + 1, d - dt.timedelta(days=1)
        return n

    assert {r.u: r.streak for r in streaks.streak(days, ["u"], F.lit(today)).collect()} == {u: want(s) for u, s in have.items()}
    spans = spark.createDataFrame([(u, today - dt.timedelta(days=3), today - dt.timedelta(days=1)) for u in have], "u int, start date, end date")
    got = {r.u: r.covered for r in streaks.covers(days, spans, ["u"], F.lit(today)).collect()}
    assert got == {u: all(today - dt.timedelta(days=k) in s for k in (1, 2, 3)) for u, s in have.items()}


def test_quests(spark):
    entry = "array<struct<kind:string,tag:string,done_key:string,flags:array<string>>>"
    schema = f"quest_id string, entries {entry}, lesson string, declared_start date, declared_reason string, streak int, through array<string>, extras map<string,string>, timer_done int, attempts array<struct<text:string>>"
    day = dt.date(2024, 1, 1)
    states = spark.createDataFrame([
        ("q1", [("walk", "sea", "2024-01-02", ["photo"]), ("walk", "hill", None, [])], " ok ", day, "why", 5, ["12-31"], {"record": "3.5 km", "a": "x"}, 2, [("4 km",)]),
        ("q2", [], "", None, None, 0, None, {}, None, None),
    ], schema)
    atoms = [("doneCount", ">=", 1, None), ("doneTag", None, None, "sea"), ("lesson", None, None, None), ("declared", None, None, None), ("reason", None, None, None), ("streak", ">", 4, None), ("streakThrough", None, None, "12-31"),
             ("flagCount", None, 1, "photo"), ("listCount", None, 2, "walk"), ("extra", None, None, "a"), ("extrasAll", None, None, "a,record"), ("timer", None, 2, None), ("newRecord", None, None, None), ("unknown", None, None, None)]
    rules = spark.createDataFrame([(q, a, op, v, t, a) for q in ("q1", "q2") for a, op, v, t in atoms], "quest_id string, atom string, op string, value int, text string, label string")
    got = {(r.quest_id, r.label): r.ok for r in streaks.evaluate(states, rules).collect()}
    assert {a for (q, a), ok in got.items() if ok} == {a for a, *_ in atoms[:-1]} and not any(ok for (q, _), ok in got.items() if q == "q2")
    assert {tuple(r) for r in streaks.progress(streaks.evaluate(states, rules)).collect()} == {("q1", 13, 14, False), ("q2", 0, 14, False)}
    plans = spark.createDataFrame([(1, dt.date(2024, 2, 1), "b"), (1, dt.date(2024, 1, 1), "a")], "u int, day date, what string")
    assert tuple(streaks.soonest(plans, ["u"]).first()) == (1, dt.date(2024, 1, 1), "a")


def test_running_total_does_not_jump(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = spark.createDataFrame([("a", t(0), 2.0), ("a", t(10), 5.0), ("b", t(5), 1.0)], "k string, ts timestamp, rate double")
    got = {r.k: r.total for r in scenario.running_total(rows, ["k"], F.lit(t(20))).collect()}
    assert got == {"a": 70.0, "b": 15.0}


# -- pages ------------------------------------------------------------------------------

PAGES = {
    "cards": '<body><section><h2>三つ</h2><div class="grid"><div><h3>A</h3><p>x</p></div><div><h3>B</h3><p>y</p></div></div></section></body>',
    "flow": '<section><h2>Work</h2><div class="cards"><div class="card">1. first</div><div class="card">2. second</div></div></section>',
    "compare": '<section><h2>Change</h2><div style="display: flex"><div><h4>Before</h4><p>slow</p></div><div><h4>After</h4><p>fast</p></div></div></section>',
    "kpi": "<section><h2>Result</h2><ul><li>sales 120%</li><li>30件 closed</li></ul></section>",
    "timeline": "<section><h2>History</h2><p>1999年 begin</p><p>2005年 grow</p></section>",
    "table": "<section><h2>T</h2><table><thead><tr><th>a</th><th>b</th></tr></thead><tr><td>1<td>2</table></section>",
    "image_text": '<section><h2>Pic</h2><p>about it</p><img src="a.png" alt="A"></section>',
    "image": '<section><h2>Pic</h2><img class="right" src="a.png"></section>',
    "bullets": "<section><h2>List</h2><ul><li>a<ul><li>b</li></ul><li>c</ul></section>",
    "title_only": "<section><h2>Alone</h2></section>",
}


def test_kinds(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "page_id string, html string")
    rows = structure.classified(structure.slides(html.elements(pages)))
    assert {r.page_id: r.kind for r in rows.collect()} == {k: k for k in PAGES}
    got = {(r.heading, r.body) for r in structure.items(rows.where("page_id = 'cards'")).collect()}
    assert got == {("A", "x"), ("B", "y")}
    over = spark.createDataFrame([("image", 1, "kpi"), ("table", 1, "nonsense")], "page_id string, slide_no int, kind string")
    fixed = {r.page_id: (r.kind, r.reason) for r in structure.overridden(rows, over).where("page_id in ('image', 'table')").collect()}
    assert fixed == {"image": ("kpi", "set by hand"), "table": ("table", "table")}
    named = spark.createDataFrame([("手順のまとめ",), ("kpi list",), ("none",)], "t string").select(structure.word_kind(F.col("t"))).collect()
    assert [r[0] for r in named] == ["flow", "kpi", None]
    assert [tuple(r[0]) for r in spark.createDataFrame([("a ： b: c",), ("x",)], "t string").select(structure.title_and_text(F.col("t"))).collect()] == [("a", "b: c"), ("x", "")]


def test_html_repairs_and_splits():
    slides = html.slides_of("<title> A  b</title><body><nav>skip</nav><h1>One</h1><p>open <b>bold<p>next<h2>Two</h2>text<br>more<script>x</script>")
    assert [s["title"] for s in slides] == ["One", "Two"]
    assert [e["lines"] for e in slides[0]["elements"]] == [["One"], ["open bold"], ["next"]]
    assert [e["lines"] for e in slides[1]["elements"]] == [["Two"], ["text"], ["more"]]
    assert html.title_of("<title> A  b</title>") == "A b"
    cover = html.slides_of("<h1>Deck</h1><p class=lead>sub</p><section><h2>S</h2><p>x</section>")
    assert cover[0]["layout"] == "title" and cover[1]["title"] == "S"
    table = html.slides_of(PAGES["table"])[0]["elements"][1]
    assert table["cells"] == [["a", "b"], ["1", "2"]] and table["header_rows"] == 1
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html.slides_of(deep)[0]["elements"][0]["lines"] == ["deep"]
    assert html.slides_of("") == []


def test_pairing():
    got = html.slides_of('<section><p>before</p><img src=a><figcaption>no</figcaption><img src=b><p>behind</p></section>')[0]["elements"]
    rows = [(e["type"], e["pair_row"], e["side"]) for e in got]
    assert rows[0] == ("text", 1, "left") and rows[1] == ("image", 1, "right")


def test_pairing_cases():
    def rows(body):
        return [(e["type"], e["pair_row"], e["side"]) for e in html.slides_of(f"<section>{body}</section>")[0]["elements"]]

    assert rows("<img src=a><p>behind</p><img src=b>") == [("image", 1, "left"), ("text", 1, "right"), ("image", None, None)]
    assert rows("<p>one</p><img src=a class=left><img src=b><p>two</p>") == [("text", 1, "right"), ("image", 1, "left"), ("image", 2, "left"), ("text", 2, "right")]
    wide = "data:image/gif;base64," + base64.b64encode(b"GIF89a" + (711).to_bytes(2, "little") + b"\1\0").decode()
    narrow = "data:image/gif;base64," + base64.b64encode(b"GIF89a" + (710).to_bytes(2, "little") + b"\1\0").decode()
    assert rows(f"<p>one</p><img src='{wide}'>") == [("text", None, None), ("image", None, None)]
    assert rows(f"<p>one</p><img src='{narrow}'>") == [("text", 1, "left"), ("image", 1, "right")]


def test_picture_widths():
    uri = lambda raw: "data:image/x;base64," + base64.b64encode(raw).decode()
    assert html.picture_width(uri(b"\x89PNG\r\n\x1a\n" + bytes(8) + (640).to_bytes(4, "big") + bytes(4))) == 640
    assert html.picture_width(uri(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03")) == 32
    assert [html.picture_width(x) for x in ("", "a.png", "data:,abc", "data:image/png;base64,?", uri(b"\xff\xd8\xff"))] == [None] * 5


def test_boxes_of_unlike_heights_are_no_cards(spark):
    schema = "page_id int, slide_no int, slide_title string, layout string, el_no int, type string, role string, lines array<string>, src string, alt string, cells array<array<string>>, header_rows int, h double"
    boxes = lambda page, *heights: [(page, 1, "t", "x", k, "shape", None, ["word"], None, None, None, None, h) for k, h in enumerate(heights)]
    made = spark.createDataFrame(boxes(1, 10.0, 16.0) + boxes(2, 10.0, 16.1) + boxes(3, 10.0, None), schema)
    assert {r.page_id: len(r.cards) for r in structure.slides(made).collect()} == {1: 2, 2: 0, 3: 2}
