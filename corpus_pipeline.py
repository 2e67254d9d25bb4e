"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents; columns beyond doc_id, text, lang, source and
n_chars pass through them untouched, whatever their names.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from docloom.llm import language_id, minhash_dedup, mixing, packing, suffix_dedup
from docloom.llm.common import crc_mod, set_aside, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words of a shingle by which near copies are judged.
SHINGLE = 5


def keeps_columns(stage):
    """The stage, working on the columns of documents under names of which none clashes."""

    @wraps(stage)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        docs, back = set_aside(docs, COLUMNS)
        return back(stage(spark, docs, sf_dir))

    return run


@keeps_columns
def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier has.

    Those with a null text or without a letter go, and all go if no training
    document has both a language and a letter.  Repeated rows are judged each
    for itself.  An empty table stays empty.
    """
    model = language_id.fit(docs.where(crc_mod("doc_id", 3) != 1))
    told = language_id.predict(docs, model)
    return told.where(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


@keeps_columns
def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies on sets of five-word shingles, the one with the smallest id.

    Rows of one id are one document, of which the first row stays.  Rows
    without an id, and texts that are null or without a word, belong to no
    group and stay.  An empty table stays empty.
    """
    found = minhash_dedup.near_duplicates(docs, width=SHINGLE)
    found = staged(found.select("doc_id", "kept"), tidy=True)
    dropped = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    #: a hash of the few dropped ids, so that texts are shuffled at most, not sorted
    kept = docs.join(dropped.hint("shuffle_hash"), "doc_id", "left_anti")
    if found.where("kept").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept.select(*docs.columns)
    first = kept.withColumn("nth_of_id", F.row_number().over(W.partitionBy("doc_id").orderBy("text", "source", "lang")))
    return first.where("nth_of_id = 1 or doc_id is null").select(*docs.columns)


@keeps_columns
def cut_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings and the passages of over 50 words that repeat.

    A character cut in two is dropped.  n_chars is the new length.  A text
    that is all repeated becomes empty; a null text stays null.  Every row
    stays, repeated rows and rows without an id too.
    """
    found = suffix_dedup.remove_repeats(docs, keep_text=True, words=suffix_dedup.PASSAGE).where("n_removed > 0")
    #: rows of one id and one text are cut alike
    found = staged(found.groupBy(F.col("doc_id").alias("cut_id"), F.col("text_sha256").alias("cut_sha")).agg(F.first("kept").alias("kept")), tidy=True)
    rows = docs.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("cut_sha")), "left")
    text = F.when(F.col("cut_sha").isNull(), F.col("text")).otherwise(F.coalesce("kept", F.lit("")))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, as often as it draws them, each with the words that it draws.

    Documents without a word are in no mix; a null source is a source of its
    own; repeated rows are drawn each for itself.  An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset; a null text is empty, and repeated rows are packed each for itself."""
    import public_tokenizers

    docs, _ = set_aside(docs, COLUMNS)
    pieces = packing.pieces_of(docs, public_tokenizers.path(packing.TOKENIZER))
    return packing.pack(staged(pieces))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), tidy=True)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
