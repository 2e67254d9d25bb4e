import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import embedding_dedup, minhash_dedup, suffix_dedup, topk_search
from docloom.llm.shingles import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def components(nodes, links):
    at = {n: n for n in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- embeddings -------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        rows.append((i, [float(x) for x in rng.standard_normal(64)], i % 3))
    base = rng.standard_normal(64)
    for i in range(400, 460):
        rows.append((i, [float(x) for x in base + 0.22 * rng.standard_normal(64)], 0))
    rows += [(i, rows[5][1], 2) for i in range(460, 464)] + [(464, rows[5][1], 1), (465, [2 * x for x in rows[5][1]], 2)]
    rows += [(466, None, 0), (467, [0.0] * 64, 0), (468, [float("nan")] * 64, 0), (469, rows[5][1], None), (470, [None] * 64, 0), (471, [], 0), (472, rows[6][1][:32], 0), (473, [float("inf")] * 64, 1), (None, rows[5][1], 2)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")


def test_embedding_links_against_all_pairs(spark, table):
    rows = vectors()
    ok = {i: (np.array(v), label) for i, v, label in rows if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(i, j) for (i, (v, a)), (j, (w, b)) in itertools.combinations(ok.items(), 2) if a == b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93]
    want = components([i for i, *_ in rows if i is not None], links)
    got = {r.vec_id: r for r in embedding_dedup.dedup_embeddings(table.withColumn("rep", F.lit(1)).withColumn("vector", F.lit(2))).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        if i is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            continue
        assert (r.n_links, r.component_id, r.kept) == (sum(i in x for x in links), want[i], want[i] == i)
    assert embedding_dedup.dedup_embeddings(table.limit(0)).count() == 0


def test_embedding_blocks_of_a_crowded_filter(spark, table, monkeypatch):
    want = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup_embeddings(table).collect()}
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.dedup_embeddings(table).collect()} == want


def test_caps_find_pairs_at_the_threshold():
    rng = np.random.default_rng(9)
    x = embedding_dedup.unit(rng.standard_normal((1500, 64)))
    side = rng.standard_normal((1500, 64))
    side = embedding_dedup.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * side
    caps = embedding_dedup.choose_caps(5000)
    (r, f), (s, g) = embedding_dedup.list_decode(x, caps), embedding_dedup.list_decode(y, caps)
    found = np.unique(np.intersect1d(r * 10**9 + f, s * 10**9 + g) // 10**9)
    assert len(found) >= 1495


@pytest.mark.parametrize("n, dim", [(1_000_000, 64), (10_000_000, 64), (100_000, 128), (10_000_000, 128)])
def test_caps_find_pairs_of_large_labels_and_wide_vectors(n, dim):
    rng = np.random.default_rng(10)
    x = embedding_dedup.unit(rng.standard_normal((300, dim)))
    side = rng.standard_normal((300, dim))
    side = embedding_dedup.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * side
    caps = embedding_dedup.choose_caps(n, dim=dim)
    found = 0
    for a in range(0, 300, 100):
        (r, f), (s, g) = embedding_dedup.list_decode(x[a : a + 100], caps), embedding_dedup.list_decode(y[a : a + 100], caps)
        found += len(set(r[i] for i in np.flatnonzero(np.isin(r * 10**12 + f, s * 10**12 + g))))
    assert found >= 299


def test_top_k_against_all_rows(spark, table):
    rows = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in vectors() if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = {}
    for i, v in rows:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            want[i] = [(j, -s) for s, j in scores[:5]]
    got = {}
    for r in topk_search.top_k(table.union(table.limit(50)).withColumn("block", F.lit(0)), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    assert topk_search.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk_search.top_k(table.where("vec_id < 3"), F.col("vec_id") == 0).count() == 2


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_bounds_of_segments_hold(seed):
    rng = np.random.default_rng(seed)
    q, c = rng.integers(-300, 300, (3, 50)).astype(float), rng.integers(-300, 300, (4, 50)).astype(float)
    for s in (1, 4, 16):
        assert (topk_search.segment_statistics(q, s) @ topk_search.segment_statistics(c, s).T >= q @ c.T - 1e-6).all()


def test_scores_beyond_longs_saturate():
    ids, x = np.array([1, 2, 3]), np.array([[2.0**70], [2.0**70], [-(2.0**70)]])
    assert topk_search.search_block(ids[:1], x[:1], ids, x, 5)[2].tolist() == [2**63 - 1, -(2**63)]


# -- documents ----------------------------------------------------------------------


def test_words():
    texts = ["Ab  cd\x0bef", "", "x", " ab"]
    raw = "".join(texts).encode()
    h, before = word_hashes(np.frombuffer(raw, np.uint8), np.cumsum([0, *map(len, texts)]))
    assert before.tolist() == [0, 3, 3, 4, 5] and h[0] == h[4] and len(set(h.tolist())) == 4


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates_against_all_pairs(documents, corpus, clashing, empty, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    sets = {i: shingles(t, 4) for i, t, *_ in corpus}
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(sets, links)
    rows = minhash_dedup.near_duplicates(clashing).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    if not small_blocks:
        assert minhash_dedup.near_duplicates(empty).count() == 0
        assert minhash_dedup.near_duplicates(documents.union(documents)).count() == 2 * len(corpus)


def test_crowded_regions_go_deeper(spark, monkeypatch):
    """Texts that share many words, so that regions are crowded, and among them pairs around the threshold."""
    rng = random.Random(11)
    common = [f"c{i}" for i in range(150)]
    texts = []
    for _ in range(70):
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([90, 120, 150]))]
        texts.append(common + own)
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = own[:]
            for _ in range(rng.choice([1, 4, 7, 9, 30])):
                near[rng.randrange(len(near))] = f"n{rng.randrange(10**6)}"
            texts.append(common + near)
    texts = [" ".join(t) for t in texts]
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    links = [(i, j) for i, j in itertools.combinations(sets, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = components(sets, links)
    assert 10 < len({c for c in want.values()}) < len(want)
    depths, plain = [], minhash_dedup._deepened

    def counted(placed, sigs):
        out = plain(placed, sigs)
        depths.append((placed.select("region").distinct().count(), out.select("region").distinct().count()))
        return out

    monkeypatch.setattr(minhash_dedup, "CROWDED", 4)
    monkeypatch.setattr(minhash_dedup, "_deepened", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == want and depths[0][0] != depths[0][1]


def plain_removal(texts):
    n = suffix_dedup.LENGTH
    count = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] = count.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats_corpus():
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [make(700), make(430), make(401)]
    texts = [make(rng.randrange(1500)) for _ in range(12)]
    for _ in range(14):
        p = rng.choice(passages)
        cut = rng.randrange(0, 60)
        texts.append(make(rng.randrange(300)) + p[cut:] + make(rng.randrange(300)) + (rng.choice(passages) if rng.random() < 0.5 else ""))
    for unit in ("a", "ab", "Is on. ", "0123456789" * 4, "x" * 60 + "y"):
        for n in (399, 400, 405, 460, 900, 2000):
            texts.append(make(rng.randrange(80)) + (unit * (n // len(unit) + 1))[:n] + make(rng.randrange(80)))
    texts += [texts[0], texts[0], None, "", "q" * 400, "q" * 400, texts[20] + texts[21]]
    return texts


@pytest.mark.parametrize("crowded", [False, True])
def test_repeats_against_all_strings(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", 3)
    texts = repeats_corpus()
    want = plain_removal([(t or "").encode() for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("tid", F.lit(1)).withColumn("sha", F.lit(1))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def plain_passages(texts, length):
    """Bytes from the first to the last word of all runs of ``length`` words that occur twice."""
    runs = {}
    words = [[(m.group().lower(), *m.span()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    for w in words:
        for i in range(len(w) - length + 1):
            key = tuple(x[0] for x in w[i : i + length])
            runs[key] = runs.get(key, 0) + 1
    out = []
    for t, w in zip(texts, words):
        gone = np.zeros(len(t), bool)
        for i in range(len(w) - length + 1):
            if runs[tuple(x[0] for x in w[i : i + length])] > 1:
                gone[w[i][1] : w[i + length - 1][2]] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [1, 3, 9, 51])
def test_passages_against_all_runs(spark, length):
    rng = random.Random(length)
    make = lambda n: " ".join(rng.choice(["a", "b", "C", "dé", "x"]) for _ in range(n))
    passages = [make(80), make(51), make(50)]
    texts = [make(rng.randrange(30)) + rng.choice([" ", "\n", "\t  "]) + rng.choice([*passages, ""]).upper() + " " + make(rng.randrange(30)) for _ in range(25)]
    texts += [texts[3], texts[3], None, "", "  ", "a " * 700, "one two three " * 40, make(60)]
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("keys", F.lit(1)).withColumn("runs", F.lit(1)).withColumn("n", F.lit(1))
    want, strings = plain_passages(raw, length), plain_removal(raw)
    told = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage) for r in suffix_dedup.remove_repeats(docs, words=length, cut_runs=False).collect()}
    assert [told[i] for i in range(len(texts))] == [(*s, int(g.sum())) for s, g in zip(strings, want)]
    cut = {r.doc_id: (r.n_removed, r.n_passage) for r in suffix_dedup.remove_repeats(docs, words=length).collect()}
    assert [cut[i][1] for i in range(len(texts))] == [int(g.sum()) for g in want]
    assert all(cut[i][0] >= max(strings[i][1], cut[i][1]) for i in range(len(texts)))


def test_repeats_across_the_end_of_a_repeated_line(spark):
    """Lines of 51 to 100 bytes; another text has the end of the stretch and what follows it."""
    texts = []
    for seed in (9, 25, 160, 188, *range(1000, 1040)):
        rng = random.Random(seed)
        make = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
        line = make(rng.randrange(51, 58 if seed < 1000 else 101))
        end, tail = rng.randrange(385, 400), rng.randrange(20, 100)
        tail = make(tail)
        stretch = (line * 60)[:1500]
        texts += [make(40) + stretch + tail + make(40), make(40) + stretch[-end:] + tail + make(40)]
    want = plain_removal([t.encode() for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_anchors_near_both_ends_of_a_repeated_line_are_kept():
    position = 7 + 54 * np.arange(40)
    keep, spans = suffix_dedup.thinned(position, np.ones(40, np.uint64))
    lo, hi = 7, int(position[-1]) + suffix_dedup.GRAM
    assert spans == [(lo, hi)] and not keep.all()
    assert keep[(position <= lo + suffix_dedup.LENGTH) | (position >= hi - suffix_dedup.GRAM - suffix_dedup.LENGTH)].all()


def test_repeats_cases(documents, corpus, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    twice = suffix_dedup.remove_repeats(documents.union(documents)).collect()
    assert len(twice) == 2 * len(corpus) and all(r.n_removed == (r.n_bytes if r.n_bytes >= 400 else 0) for r in twice)
    kept = suffix_dedup.remove_repeats(documents, keep_text=True).collect()
    texts = {i: (t or "").encode() for i, t, *_ in corpus}
    assert all(len(r.kept.encode()) == len(texts[r.doc_id]) - r.n_removed for r in kept if r.kept is not None)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=70).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=25), st.integers(1, 2))
def test_deep_shallow_order(strings, heads):
    head = np.array([i % heads for i in range(len(strings))], np.uint64)
    order, lcp = suffix_dedup.deep_shallow(head, strings)
    assert sorted(order.tolist()) == list(range(len(strings)))
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        if head[a] != head[b]:
            assert lcp[k] == -1 and head[a] < head[b]
        else:
            assert strings[a] <= strings[b] and lcp[k] == suffix_dedup.common_prefix(strings[a], strings[b])
