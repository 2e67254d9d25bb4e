import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import mixing, sharding
from docloom.llm.common import find_range

WORD = re.compile(mixing.WORD)


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    out = mixing.targets(sizes, weights)
    assert sum(out) == pytest.approx(1.5 * sum(sizes))
    assert all(t <= 2 * s + 1e-9 for t, s in zip(out, sizes))
    free = [t / w for t, s, w in zip(out, sizes, weights) if t < 2 * s - 1e-9]
    assert not free or max(free) == pytest.approx(min(free))
    assert all(2 * s / w <= max(free) + 1e-9 for t, s, w in zip(out, sizes, weights) if free and t >= 2 * s - 1e-9)


def test_permutation_is_one(spark):
    rows = spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000), F.lit(3)).alias("p")).collect()
    got = [r.p for r in rows]
    assert sorted(got) == list(range(1000)) and sum(a == i for i, a in enumerate(got)) < 30


def test_mix(spark, documents, corpus, clashing, empty):
    rows = {r.doc_id: r for r in mixing.mix(clashing).collect()}
    assert len(rows) == len(corpus)
    size, by = {}, defaultdict(list)
    for i, t, _, source, _ in corpus:
        size[i] = len(WORD.findall(t or ""))
        by[source].append(i)
    names = sorted(s for s in by if s is not None) + [None]
    sizes = [sum(size[i] for i in by[s]) for s in names]
    want = mixing.targets(sizes, [mixing.WEIGHTS[k % 3] for k in range(len(names))])
    for s, total, target in zip(names, sizes, want):
        assert all(rows[i].size == size[i] and rows[i].source_size == total and rows[i].target == pytest.approx(target) for i in by[s])
        assert abs(sum(rows[i].taken for i in by[s]) - target) <= max(2, 0.02 * total)
    assert all(r.taken <= 2 * r.size for r in rows.values())
    again = {r.doc_id: r.taken for r in mixing.mix(documents.repartition(7)).collect()}
    assert again == {i: r.taken for i, r in rows.items()}
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


@pytest.mark.parametrize("repeat", [False, True])
def test_mixed_documents_hold_what_is_taken(documents, corpus, repeat):
    docs = documents.union(documents.limit(70)) if repeat else documents
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    got = Counter()
    texts = {i: t for i, t, *_ in corpus}
    for r in mixing.mixed_documents(docs).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text) and set(WORD.findall(r.text)) <= set(WORD.findall(texts[r.doc_id]))
    assert {i: n for i, n in taken.items() if n} == {i: n for i, n in got.items() if n}


def test_slots_name_each_block_once_per_epoch(spark):
    sources = [mixing.Source("sa", 100, 150.0, 1, 100, 150), mixing.Source("sb", 60, 60.0, 1, 60, 60)]
    rows = mixing.draw_blocks(spark, sources).collect()
    seen = Counter((r.s, r.epoch, r.block) for r in rows)
    assert max(seen.values()) == 1 and Counter(r.s for r in rows) == {0: 150, 1: 60}
    assert len({(r.shard, r.slot) for r in rows}) == 210


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 9, 16, 17, 30])
def test_find_range(spark, n):
    bounds = [3 * i for i in range(n)]
    rows = spark.range(-2, 3 * n + 4).select("id", find_range(bounds, F.col("id")).alias("at")).collect()
    assert all(r["at"] == sum(b <= r["id"] for b in bounds) for r in rows)


def check_shards(rows, texts, shards):
    size = Counter()
    slots = defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    return size


def test_shards(documents, corpus, clashing, empty):
    texts = {i: t for i, t, *_ in corpus}
    rows = sharding.shard(clashing, 4).collect()
    assert len(rows) == len(corpus)
    check_shards(rows, texts, 4)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    assert sharding.shard(empty).count() == 0
    check_shards(sharding.shard(documents.union(documents), 3).collect(), texts, 3)


def test_shards_are_even_and_split_a_heavy_group(spark):
    texts = {i: ("hot text " * 5 if i % 2 else f"text {i} " * 5) for i in range(4000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    size = check_shards(sharding.shard(docs).collect(), texts, 8)
    assert max(size.values()) < 1.15 * min(size.values())


def test_light_groups_beside_a_heavy_text_stay_together(spark):
    texts = {i: ("heavy text " * 9 if i < 6000 else f"group {i // 3} of three") for i in range(15_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    size = check_shards(rows, texts, 8)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert [len(s) for t, s in where.items() if len(s) > 1] == [8] and max(size.values()) < 1.15 * min(size.values())
