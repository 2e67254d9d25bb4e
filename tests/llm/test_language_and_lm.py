import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import language_id, lm_scoring
from docloom.llm.common import crc_mod

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SENTENCES = {"en": "the house of the river and the people with this that", "de": "das haus und der fluss mit den leuten nicht eine", "fr": "la maison du fleuve avec les gens pour une été"}


def test_language_held_out_accuracy(spark):
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(SENTENCES[lang].split(), k=rng.randrange(4, 40))), lang) for i in range(600) for lang in [list(SENTENCES)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.where(crc_mod("doc_id", 3) != 1), rows_per_language=50)
    got = language_id.predict(docs, model).where(crc_mod("doc_id", 3) == 1)
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_cases(spark, documents, empty, clashing):
    model = language_id.fit(documents)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in language_id.predict(clashing, model).collect()}
    for r in got.values():
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred in ("de", "en")) == letter and (r.lang_pred == "und") == (not letter)
    assert set(clashing.columns) <= set(language_id.predict(clashing, model).columns)
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert nothing.languages == [] and {r.lang_pred for r in language_id.predict(documents, nothing).collect()} == {"und"}


def test_grams_do_not_cross_documents():
    texts = ["ab", "", "abc", "é"]
    raw = "".join(texts).encode()
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    _, grams, starts = language_id._grams(np.frombuffer(raw, np.uint8), off)
    counts = [int((grams[a:b] >= 0).sum()) for a, b in zip(starts, starts[1:])]
    assert counts == [1, 0, 3, 0]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def tokens(t):
    return [*WORD.findall((t or "").translate(LOWER)), "\n"]


def plain_scores(corpus, order, prior=lm_scoring.PRIOR):
    """The same model with dictionaries, by recursion over contexts."""
    train = [tokens(t) for i, t, *_ in corpus if not held_out(i)]
    c = Counter(w for x in train for w in x)
    total, distinct = sum(c.values()), len(c)
    grams, contexts = Counter(), Counter()
    for x in train:
        s = ["<s>", *x]
        for n in range(2, order + 1):
            for k in range(len(s) - n + 1):
                grams[tuple(s[k : k + n])] += 1
                contexts[tuple(s[k : k + n - 1])] += 1

    def p(w, h):
        if not h:
            return (c[w] + 1) / (total + distinct + 1)
        return (grams[h + (w,)] + prior * p(w, h[1:])) / (contexts[h] + prior)

    out = {}
    for i, t, *_ in corpus:
        s = ["<s>", *tokens(t)]
        out[i] = (sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in s[1:]), sum(math.log10(p(s[k], tuple(s[max(0, k - order + 1) : k]))) for k in range(1, len(s))))
    return out, total, c, p


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_agree_with_dictionaries(documents, corpus, order):
    want, total, c, _ = plain_scores(corpus, order)
    rows = lm_scoring.score_documents(documents, crc_mod("doc_id", 7) == 2, order).collect()
    assert len(rows) == len(corpus)
    texts = {i: t for i, t, *_ in corpus}
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id), len(w), sum(c[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(want[r.doc_id][0]) and r.score == pytest.approx(want[r.doc_id][1])
        assert r.gain == pytest.approx((r.score - r.base_score) / r.n_tokens)


def test_many_chunks_and_parts(documents, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 9_000)
    monkeypatch.setattr(lm_scoring, "PART_BYTES", 3_000)
    monkeypatch.setattr(lm_scoring, "HELD", 50)
    want = plain_scores(corpus, 3)[0]
    rows = lm_scoring.score_documents(documents, crc_mod("doc_id", 7) == 2).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r.base_score, r.score) == (pytest.approx(want[r.doc_id][0]), pytest.approx(want[r.doc_id][1]))


@given(st.lists(st.integers(0, 2**63 - 1), max_size=200))
def test_keys_come_back(keys):
    keys = np.unique(np.array(keys, np.uint64))
    assert np.array_equal(lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys)), keys)
    assert np.array_equal(lm_scoring.unpacked(lm_scoring.packed(keys)), keys)
    edges = lm_scoring.part_edges(keys, 63, 8)
    assert len(edges) == 9 and edges[-1] == len(keys) and all(set((keys[a:b] >> np.uint64(60)).tolist()) <= {p} for p, (a, b) in enumerate(zip(edges, edges[1:])))


def test_probabilities_sum_to_one(corpus):
    _, total, c, p = plain_scores(corpus, 3)
    for h in [("<s>",), ("w1",), ("w1", "w2"), ("x <|endoftext|>",)]:
        assert sum(p(w, h) for w in [*c, "never seen"]) == pytest.approx(1)


def test_lm_empty_and_untrained(spark, documents, corpus, empty):
    assert lm_scoring.score_documents(empty, F.lit(False)).count() == 0
    rows = lm_scoring.score_documents(documents, F.lit(True)).collect()
    assert len(rows) == len(corpus) and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)


def test_lm_with_frequent_words_only(spark):
    docs = spark.createDataFrame([(i, "a b a b a") for i in range(12)], "doc_id long, text string")
    rows = lm_scoring.score_documents(docs, F.col("doc_id") == 3).collect()
    assert len(rows) == 12 and all(r.n_known == r.n_tokens == 6 and r.train_tokens == 66 for r in rows)
    assert len({(r.base_score, r.score) for r in rows}) == 1 and rows[0].score > rows[0].base_score


def test_rare_grams_of_a_large_corpus_count(spark):
    """Grams seen twice count among 13 million tokens as they do among a few."""
    many = spark.range(13).select("id", F.expr("repeat('a ', 1000000)").alias("text"))
    few = spark.createDataFrame([(100 + i, "x y z") for i in range(3)], "id long, text string")
    rows = lm_scoring.score_documents(many.union(few), F.col("id") == 102, id_col="id", prior=4.0).where("held_out").collect()
    n, v = 13_000_000 + 6 + 15, 5
    assert [r.train_tokens for r in rows] == [n]
    low = [3 / (n + v + 1)] * 3 + [16 / (n + v + 1)]
    first = (2 + 4 * low[0]) / (15 + 4)  # of START, x
    two = [(2 + 4 * p) / (2 + 4) for p in low[1:]]
    three = [(2 + 4 * p) / (2 + 4) for p in two]
    assert rows[0].score == pytest.approx(math.log10(first) + sum(map(math.log10, three)))


def test_repeated_rows_without_an_id_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 40 + [(1, "a b d")], "doc_id long, text string")
    rows = lm_scoring.score_documents(docs, F.col("doc_id") == 1).collect()
    assert len(rows) == 41 and {(r.doc_id, r.held_out, r.n_known, r.train_tokens) for r in rows} == {(None, False, 4, 160), (1, True, 3, 160)}
