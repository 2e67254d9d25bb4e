import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): copies, near copies, shared passages, nulls, empty and long texts."""
    rng = random.Random(7)
    passage = " ".join(words(rng, 90))
    rows = []
    for i in range(60):
        rows.append(" ".join(words(rng, rng.randrange(3, 300))))
    base = words(rng, 200)
    for _ in range(12):  # near copies around one text
        w = base[:]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 3
    for _ in range(5):
        rows.append(" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 40)))
    rows += [None, "", " ", "one", "One", "two words", "a b c", "A b C", "1 2 3 4 5", "là où ça été", "日本語 の 文章 です", "ab " * 900, "=" * 1500, " ".join(words(rng, 6000)), "x <|endoftext|> y  z\n\n 1234 it's"]
    out = [(k, t, [None, "en", "de"][k % 3], [None, "b", "a", "é", "b"][k % 5], len(t) if t is not None else None) for k, t in enumerate(rows)]
    return out


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(documents):
    """Columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    out = documents
    for c in ("id", "s", "n", "size", "key", "range", "rep", "tid", "sig", "score", "chunk", "start", "length", "kept", "salt", "grams"):
        out = out.withColumn(c, F.lit("x"))
    return out
