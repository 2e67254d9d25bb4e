"""Rows without an id, in every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import language_id, lm_scoring, minhash_dedup, mixing, packing, sharding, suffix_dedup, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    long = "some words that are long enough to be cut " * 12
    rows = [(None, long, None, None, 5), (None, long, "en", "a", None), (1, long + "x", "en", "a", 3), (None, None, None, None, None), (None, "", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("operator", [
    lambda d: packing.pack(packing.pieces_of(d, PATH)), lambda d: language_id.predict(d, language_id.fit(d)), lambda d: token_counts.count_tokens(d, PATH), mixing.mix, sharding.shard,
    minhash_dedup.near_duplicates, suffix_dedup.remove_repeats, lambda d: lm_scoring.score_documents(d, F.col("doc_id").isNull()),
])
def test_rows_without_an_id_stay(docs, operator):
    rows = operator(docs).collect()
    assert len(rows) == 5 and sum(r.doc_id is None for r in rows) == 4


def test_repeats_and_groups(docs):
    removed = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert removed == {(None, 504, 504), (1, 505, 505), (None, 0, 0)} or removed == {(None, 504, 504), (1, 505, 504), (None, 0, 0)}
    groups = {(r.doc_id, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert groups == {(None, None, False), (1, 1, True)}


def test_pipeline_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() >= 3
