"""Models of the package against restatements in plain Python, and rows without an id in the operators on vectors."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import embedding_dedup, language_id, lm_scoring, packing, topk_search

# -- language identification -------------------------------------------------------------


def plain_grams(text):
    """Buckets of the 2- and 3-grams of a text, A-Z lowered, in unsigned 32-bit arithmetic."""
    c, m = [ord(x) + 32 if "A" <= x <= "Z" else ord(x) for x in text], (1 << 32) - 1
    two = [((((a * 0x9E3779B1 + b * 0x85EBCA77) ^ 0x27D4EB2F) & m) * 0x2C1B3C6D & m) >> 16 for a, b in zip(c, c[1:])]
    return two + [(((a * 0xC2B2AE3D + b * 0x165667B1 + d * 0x9E3779B1) & m) * 0x297A2D39 & m) >> 16 for a, b, d in zip(c, c[1:], c[2:])]


def test_bayes_equals_dictionaries(spark, documents, corpus):
    learned = [(r[1] or "", r[2]) for r in corpus if r[2] is not None]
    seen, rows = defaultdict(Counter), Counter(lang for _, lang in learned)
    for text, lang in learned:
        seen[lang].update(plain_grams(text))
    n = language_id.BUCKETS
    got = {r.doc_id: r for r in language_id.predict(documents, language_id.fit(documents, 10**9)).collect()}
    for i, text, *_ in corpus:
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        log = {lang: math.log(rows[lang] / len(learned)) + sum(math.log((seen[lang][g] + 1) / (seen[lang].total() + n)) for g in plain_grams(text)) for lang in sorted(seen)}
        best = max(log, key=log.get)
        share = 1 / sum(math.exp(v - log[best]) for v in log.values())
        if share > 0.51:  # below, rounding may decide
            assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(share, abs=0.02)


# -- the backoff automaton -----------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3, 5])
@pytest.mark.parametrize("stretch", [2, 512])
def test_automaton_equals_counts(monkeypatch, order, stretch):
    """Each token's weight is the interpolated share, whatever the order and wherever a long text is taken up again."""
    monkeypatch.setattr(lm_scoring, "STRETCH", max(stretch, order - 1))
    rng = random.Random(order)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xy ") for _ in range(rng.randrange(0, 300))) for _ in range(40)] + ["", None, "zz unseen"]
    hold, prior = [rng.random() < 0.4 for _ in texts[:-1]] + [True], 7.0
    tokens = [["<s>", *(t or "").split(), "</s>"] for t in texts]
    grams = Counter(tuple(t[max(0, i - k) : i + 1]) for t, h in zip(tokens, hold) if not h for i in range(len(t)) for k in range(min(order, i + 1)))
    total = sum(len(t) - 1 for t, h in zip(tokens, hold) if not h)
    distinct, learned = len({w for t, h in zip(tokens, hold) if not h for w in t[1:]}), hold.count(False)

    def share(context, word):
        p = ((grams[(word,)] if word != "<s>" else 0) + 1) / (total + distinct + 1)
        for k in range(1, len(context) + 1):
            if grams[tuple(context[-k:])]:
                p = (grams[(*context[-k:], word)] + prior * p) / (grams[tuple(context[-k:])] + prior)
            else:
                break
        return p

    for a, b, words, before in lm_scoring.sequences(pa.array(texts)):
        seq, starts = lm_scoring.framed(words, before)
        of = np.repeat(np.arange(a, b), np.diff(np.append(starts, len(seq))))
        place = np.arange(len(seq)) - starts[of - a]
        found, counts = [], []
        for level, (k, ok) in enumerate(lm_scoring.grams(seq, order)):
            found.append((k >> np.uint64(1), ok))
            counts.append(np.array([grams[tuple(tokens[t][i - level : i + 1])] if o else 0 for t, i, o in zip(of, place, ok)], np.uint64))
        automaton = lm_scoring.Automaton(seq, starts, found, counts, total, distinct, learned, prior)
        got = lm_scoring.walked(seq, starts, automaton, order)
        for at, (t, i) in enumerate(zip(of, place)):
            if i:
                assert got[at] == pytest.approx(math.log10(share(tokens[t][max(0, i - order + 1) : i], tokens[t][i]))), (t, i)


# -- packing -------------------------------------------------------------------------------


def test_completion_makes_the_packing():
    """Where bin completion needs no more bins than best fit, its bins are the result."""
    rng = random.Random(3)
    by_completion = 0
    for kind in range(6):
        lengths = [rng.randrange(1, 2049) if kind < 3 else min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(4000)]
        counts = [0] * 2049
        for x in lengths:
            counts[x] += 1
        limit = packing.bins_of(packing.best_fit_patterns(counts, 2048))
        made, got = packing.complete(counts, 2048, limit + 1), packing.few_bins(counts, 2048)
        assert packing.bins_of(got) <= limit and Counter(x for f, n in got for x in f for _ in range(n)) == Counter(lengths) and all(sum(f) <= 2048 for f, _ in got)
        if made is not None:
            by_completion += 1
            assert packing.bins_of(got) <= packing.bins_of(made)
    assert by_completion >= 5


# -- vectors without an id -------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    rows = [(None, base.tolist(), "a"), (None, base.tolist(), "a"), (1, base.tolist(), "a"), (2, (base + 1e-3).tolist(), "a"), (3, None, "a"), (None, None, None), (100, base.tolist(), None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


def test_vectors_without_an_id(vectors):
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup_embeddings(vectors).collect()), key=str)
    assert got == sorted([(None, 0, None, False)] * 3 + [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (100, 0, 100, True)], key=str)
    rows = topk_search.top_k(vectors, (vectors.vec_id % 50 == 0)).collect()
    assert rows and all(r.query_id is not None and r.vec_id is not None and r.query_id != r.vec_id for r in rows)
