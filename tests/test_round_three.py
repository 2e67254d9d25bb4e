"""Queries on rows that the given tables don't hold."""

import math
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as driver
from docloom import catalog
from docloom.functions import codec, digest, pii
from docloom.operators import chunking, diagrams, similarity
from docloom.sources import html


def both(spark, name, folder, **tables):
    """The rows of a query and of its SQL over tables written to a folder."""
    duck = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        duck.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = duck.sql(catalog.ORACLE_SQL[name])
    return sorted(map(tuple, driver.queries()[name](spark, str(folder)).select(*want.columns).collect())), sorted(want.fetchall())


def test_numbered_lines_that_are_too_long_ask_nothing(spark, tmp_path):
    texts = [(1, "28.68.191 238 Den schüsch ö geösch erzu chüpfber.\nZu und. Dieüauß der.\n1. kurz"), (2, "1. " + "x" * 45), (3, ""), (4, "a\n\n" + "b" * 40 + "\n" + "c" * 41)]
    got, want = both(spark, "document_questions", tmp_path, documents=spark.createDataFrame(texts, "doc_id long, text string"))
    assert got == want and {r[0] for r in got} == {1, 4}


def test_colors_of_exactly_half_the_brightness(spark, tmp_path):
    got, want = both(spark, "colors", tmp_path, part=spark.createDataFrame([(782613, 5), (167690, 17), (1099516, 32), (1, 1)], "p_partkey long, p_size int"))
    assert got == want


def test_sketches_at_the_threshold_share_keys_and_others_few():
    rng, most = np.random.default_rng(5), similarity.SKETCH
    pool = rng.integers(-(2**63), 2**63 - 1, 3000)
    counts = np.bincount(pool % similarity.BUCKETS, rng.integers(2, 90, len(pool)), similarity.BUCKETS).astype(np.int32)
    keys = lambda s: set(similarity.keys_of(np.sort(s), counts, 0.9).tolist())
    for n in [*range(1, 32), 50, most] * 3:
        size = max(n, rng.integers(n, math.floor(n / 0.9) + 1))
        shared = math.ceil(0.9 * size)
        if shared <= n:
            a = rng.choice(pool, min(most, n + size - shared), replace=False)
            one, two = a[:n], np.concatenate([a[:shared], a[n:]])[:size]
            assert len(keys(one) & keys(two)) >= similarity.MEET
    strangers = [keys(rng.choice(pool, most, replace=False)) for _ in range(60)]
    assert sum(len(a & b) >= similarity.MEET for i, a in enumerate(strangers) for b in strangers[:i]) < 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_python_takes_texts_and_pages_in_slices(spark):
    docs = spark.createDataFrame([(i, "line\n" * 300 + str(i)) for i in range(40)], "doc_id long, text string")
    got = chunking.chunk(docs, "lines", 1000)
    assert "MapInArrow" in plan_of(got) and got.count() == 40 * 2 and chunking.SLICE_CHARS < 10_000_000
    pages = spark.createDataFrame([(i, "<p>a</p>" * 300) for i in range(30)], "page_id long, html string")
    assert html.elements(pages).groupBy("page_id").count().where("count = 300").count() == 30 and html.SLICE_ELEMENTS < 30 * 300


def test_lines_of_a_card_are_cut_and_read_without_expansion(spark):
    cards = spark.createDataFrame([(1, "あ" * 95), (2, "い" * 40), (3, "")], "slot long, data string")
    lines = codec.card_lines(cards)
    assert sorted((r.slot, r.line, len(r.data)) for r in lines.collect()) == [(1, 0, 40), (1, 1, 40), (1, 2, 15), (2, 0, 40)]
    back = codec.read_card(lines)
    assert "Expand" not in plan_of(back) and "substr" not in plan_of(lines) and {(r.slot, len(r.data), r.ok) for r in back.collect()} == {(1, 95, True), (2, 40, True)}


def test_characters_are_counted_without_a_row_each(spark):
    got = codec.used_characters(spark.createDataFrame([("aé𠮷a",), (None,), ("",), ("é\n",)], "text string"))
    assert "Generate" not in plan_of(got) and {(r.cp, r.n) for r in got.collect()} == {(97, 2), (233, 2), (0x20BB7, 1), (10, 1)}


def test_masks_by_kinds_that_a_text_may_hold(spark):
    texts = ["", "x@y.de", "a 1234-5678-9012-3456 b", "090-1234-5678 a@b.com", "1234567890123456", "123456789012", "1234-5678-9012", "1234 12-34", "01-2-3456", None]
    c = F.col("c")
    rows = spark.createDataFrame([(x,) for x in texts], "c string").select(pii.mask(c, ["34"]), pii.mask_counts(c, ["34"]), pii.scan(c, ["34"]), pii.may_hold(c, "card")).collect()
    for x, (masked, counts, seen, digits) in zip(texts, rows):
        want, n, first = x, {}, {}
        for kind, p in [*pii.BUILT_IN.items(), ("dictionary", "34")] if x is not None else []:
            n[kind], first[kind] = len(re.findall(p, want)), len(re.findall(p, x))
            want = re.sub(p, pii.MASK, want)
        assert (masked, counts, seen) == (want, {k: v for k, v in n.items() if v}, {k: v for k, v in first.items() if v})
        assert digits or not any(n.get(k) for k in ("card", "my_number", "phone"))


def test_only_documents_with_repeats_give_lines(spark):
    docs = spark.createDataFrame([(1, "x" * 40 + "\n" + "y" * 40), (2, " " + "x" * 40 + "\na\n" + "x" * 40 + "\u3000\n#" + "z" * 40), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in digest.repeated_lines(docs).collect()] == [(2, "x" * 40, 2, 1)]
    assert "array_distinct" in plan_of(digest.repeated_lines(docs))


def test_boxes_of_small_slides_are_grouped_in_one_row(spark, monkeypatch):
    def grid(*_):
        raise AssertionError("no slide is crowded")

    monkeypatch.setattr(diagrams, "touching", grid)
    boxes = [(i // 5 if i < 90 else None, i, float(i % 5 * 30), float(i % 3), 10.0 + i % 13, 5.0) for i in range(100)]
    got = diagrams.groups_of_boxes(spark.createDataFrame(boxes, "slide int, node long, x double, y double, w double, h double"), ["slide"], 12.0)
    assert plan_of(got).count("Exchange hashpartitioning") == 1 and "Join" not in plan_of(got)
    assert len({r.grp for r in got.collect()}) > 20


def test_boxes_in_one_row_and_on_the_grid_give_the_same_groups(spark):
    rng, boxes = np.random.default_rng(3), []
    for slide in (None, *range(30)):
        for _ in range(diagrams.FEW + 1 - rng.integers(0, 2) if slide and slide % 9 == 0 else rng.integers(1, 14)):
            x, y, w, h = (float(v) for v in rng.integers(0, [400, 300, 60, 60]) / 4 * rng.choice([1, 4]))
            boxes.append((slide, len(boxes), x, y, w, h))
    boxes += [(1, 0, 5.0, 5.0, 1.0, 1.0), (2, 900, 1.0, 1.0, 1.0, 1.0), (3, 900, 390.0, 290.0, 1.0, 1.0), (4, 901, 1.0, 1.0, 1.0, 1.0), (4, 901, 399.0, 299.0, 1.0, 1.0), (5, 902, 1.0, None, 1.0, 1.0), (5, 903, 1.0, 1.0, None, 1.0), (6, 904, 0.0, 0.0, -90.0, 1.0), (6, 905, 0.0, 0.0, -90.0, 1.0)]
    near = lambda a, b: None not in (*a[2:], *b[2:]) and (a[2:] == b[2:] or all(p[k] - 1.5 <= q[k] + q[k + 2] + 1.5 for k in (2, 3) for p, q in ((a, b), (b, a))))
    links = [(a[1], b[1]) for a in boxes for b in boxes if a[1] != b[1] and a[0] == b[0] and near(a, b)]
    root = {b[1]: b[1] for b in boxes}
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame(boxes, "slide int, node long, x double, y double, w double, h double").repartition(5)
    got = diagrams.groups_of_boxes(table, ["slide"], 3.0).collect()
    assert sorted((tuple(r)[:2], *tuple(r)[3:]) for r in got if None not in tuple(r)) == sorted(((b[0], b[1]), *b[2:]) for b in boxes if None not in b)
    assert {(r.node, r.grp) for r in got} == set(root.items()) and len(got) == len(boxes) and 20 < len({*root.values()}) < len(root)


def test_items_are_sorted_in_all_shuffle_partitions(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i % 23, i, int(rng.integers(0, 90)), i % 7, float(rng.integers(1, 51)), "AN"[i % 2], "O") for i in range(400)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string")
    got, want = both(spark, "diagram_items", tmp_path, lineitem=table)
    assert got == want and len(got) > 100
    rows = driver.queries()["diagram_items"](spark, str(tmp_path))
    assert plan_of(rows).count("Exchange") == 1 and plan_of(rows).count("+- Sort ") == 3
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_items_of_boxes_that_tie_do_not_depend_on_the_order_of_rows(spark):
    rows = [(kind, 1, 7, f"diagram:{kind}:d:1", [head, *rest], 1.0, 2.0) for kind in ("kpi", "timeline", "compare", "flow") for head in "cabed" for rest in (["z"], ["y"], [])]
    schema = "page_id string, slide_no int, el_no long, name string, lines array<string>, x double, y double"
    got = [diagrams.items(diagrams.members(spark.createDataFrame(r, schema).coalesce(1))).orderBy("kind", "item_no").collect() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and [(r.title, r.text) for r in got[0] if r.kind == "flow"][:4] == [("a", None), ("a", "y"), ("a", "z"), ("b", None)]


def test_parities_differ_in_no_more_bits_than_sketches_in_values():
    rng = np.random.default_rng(6)
    for _ in range(200):
        a, b = (np.unique(rng.integers(-(2**63), 2**63 - 1, 30)[: rng.integers(1, 31)]) for _ in "ab")
        a = np.union1d(a, b[: rng.integers(0, len(b) + 1)])
        bits = sum(int(x).bit_count() for x in (similarity.parities(a) ^ similarity.parities(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b)) and bits % 2 == len(np.setxor1d(a, b)) % 2


def test_pairs_of_like_documents_come_from_few_keys(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 9000, n))
    base = words(300)
    docs = [base + " " + words(6) for _ in range(30)] + [base[:1100] + words(60) for _ in range(30)] + [words(300) for _ in range(20)]
    signed = similarity.signatures(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    firsts = similarity.first_texts(signed).cache()
    sketches = {r.id: set(r.sketch) for r in firsts.collect()}

    def alike(a, b):
        union = sorted(sketches[a] | sketches[b])[: similarity.SKETCH]
        return sum(h in sketches[a] and h in sketches[b] for h in union) / len(union)

    want = {(a, b): alike(a, b) for a in sketches for b in sketches if a < b and min(len(docs[a]), len(docs[b])) / max(len(docs[a]), len(docs[b])) >= 0.81 and alike(a, b) >= 0.9}
    for block, compared in ((1000, 10_000), (7, 50)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "COMPARED", compared)
        met = [tuple(r)[:2] for r in similarity.meetings(similarity.prefixes(firsts, 0.9), 0.9).collect()]
        assert set(want) <= set(met) and len(want) >= 400 and len(met) < 6 * len(set(met))
        assert {(r.a, r.b): r.similarity for r in similarity.similar_pairs(signed).collect()} == want
