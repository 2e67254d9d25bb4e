"""Token counts by the whole-token shortcut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow, table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Which vocabulary strings encode alone as one token is proved once on the
    driver (:class:`bpe.Bpe`, a few MB, broadcast); pre-tokens found among
    them count one each, the others are merged.  Parts of texts are remembered
    in a memo of bounded size.  No shuffle; a row is worked on alone.

    Null or empty text: 0 bytes, 0 tokens.  Special strings inside a text are
    one token each.  Repeated rows give repeated rows; an empty table gives an
    empty table; other columns are not looked at.
    """
    rules = docs.sparkSession.sparkContext.broadcast(bpe.Bpe(path))

    def run(batches):
        encoder = bpe.Encoder(rules.value, len)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            n_bytes, n_tokens = [], []
            for t in texts:
                text = t.as_py() or ""
                n_bytes.append(len(text) if text.isascii() else len(text.encode("utf-8")))
                n_tokens.append(sum(encoder.parts(text)))
            counts = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), counts], names=["id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
