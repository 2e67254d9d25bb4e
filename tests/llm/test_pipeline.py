import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from docloom.llm import minhash_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    return path


def test_stage_by_stage(spark, folder, corpus, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == 4 or out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
    texts = {i: t for i, t, *_ in corpus}
    assert {r.doc_id for r in seen[0]} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    found = {r.doc_id: r.kept for r in minhash_dedup.near_duplicates(spark.read.parquet(f"{tmp_path}/0"), width=5).collect()}
    assert sorted(r.doc_id for r in seen[1]) == sorted(i for i, kept in found.items() if kept)
    assert all(texts[r.doc_id] == r.text for r in seen[1])
    assert sorted(r.doc_id for r in seen[2]) == sorted(r.doc_id for r in seen[1])
    shared = [r for r in seen[2] if len(r.text) < len(texts[r.doc_id])]
    assert len(shared) >= 5 and all(r.n_chars == len(r.text) for r in seen[2])
    words = {r.doc_id: Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in seen[2]}
    taken = Counter()
    for r in seen[3]:
        w = Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert w and not w - words[r.doc_id]
        taken[r.doc_id] += sum(w.values())
    assert all(n <= 2 * sum(words[i].values()) for i, n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sum(w.values()) for w in words.values()), rel=0.02)
    assert Counter(r.doc_id for r in seen[4] if r.piece == 0) == Counter(r.doc_id for r in seen[3])
    rest = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in rest) == Counter((r.doc_id, r.piece, r.ids_crc32) for r in seen[4])


def test_repeated_rows_and_empty_table(spark, documents, empty, tmp_path):
    twice = documents.union(documents)
    kept = corpus_pipeline.drop_near_duplicates(spark, twice, "")
    assert max(r["count"] for r in kept.groupBy("doc_id").count().collect()) == 1
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, "").count() == 0


NAMES = ["s", "start", "kept", "take", "takes", "nth", "own_size", "cut_id", "cut_sha", "text_sha256", "score", "lang_pred", "TEXT", "Doc_Id", "aside_0", "n"]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_clashing_columns(spark, documents, stage):
    rows = documents.union(documents.limit(3))
    more = rows.toDF(*rows.columns).select("*", *[F.lit(f"as it was {k}").alias(c) for k, c in enumerate(NAMES)])
    plain, got = stage(spark, rows, ""), stage(spark, more, "")
    if stage is not corpus_pipeline.pack_sequences:
        assert got.columns == more.columns
        assert all(tuple(r)[len(COLUMNS):] == tuple(f"as it was {k}" for k in range(len(NAMES))) for r in got.collect())
        assert Counter(tuple(r)[: len(COLUMNS)] for r in got.collect()) == Counter(tuple(r) for r in plain.collect())
    else:
        assert got.columns == plain.columns and got.count() == plain.count()


def test_rows_without_an_id_are_cut_each_for_itself(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " abc", passage + " xyz", None, None, "lone"]
    docs = spark.createDataFrame([(None, t, "en", "a", None) for t in texts], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    got = corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()
    assert sorted((r.text is None, r.text) for r in got if r.text is not None) == [(False, " abc"), (False, " xyz"), (False, "lone")] and len(got) == 5


def test_five_words_decide_near_copies(spark):
    """A change of one word costs four shingles of four words and five of five."""
    words = [f"w{i}" for i in range(34)]
    docs = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join([*words[:15], "other", *words[16:]]), "en", "a", 1)], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    assert corpus_pipeline.drop_near_duplicates(spark, docs, "").count() == (1 if 25 / 35 >= 0.8 else 2)


def test_passages_of_short_words_are_cut(spark):
    passage = [f"{chr(97 + i % 26)}{i % 10}" for i in range(52)]
    rows = [(1, "one " + " ".join(passage) + " two"), (2, "Three\n" + "  ".join(passage[:51]).upper() + " four"), (3, "five " + " ".join(passage[:50]) + " six"), (4, " ".join(["a b"] * 40)), (5, " ".join(f"n{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in COLUMNS))
    got = {r.doc_id: r for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert {i: r.text.split() for i, r in got.items()} == {1: ["one", passage[51], "two"], 2: ["Three", "four"], 3: rows[2][1].split(), 4: [], 5: rows[4][1].split()}
    assert all(r.n_chars == len(r.text) for r in got.values())
