"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, table, text_slices

#: Hash buckets for the 2- and 3-grams together.
BUCKETS = 1 << 16
#: Training rows that are read per language, about; the only bound on what the fit sees.
ROWS_PER_LANGUAGE = 4000
UNKNOWN = "und"
_SLICE = 1 << 20


@dataclass
class Model:
    """log P(bucket | language), one row per language in code point order.

    Its size is languages x BUCKETS x 4 bytes, whatever the corpus holds.
    """

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def _grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (A-Z lowered), bucket of each gram, first gram of each document.

    A document of n characters has n - 1 bigrams and n - 2 trigrams, laid out
    as two interleaved entries per character; entries that would cross the
    end of a document fall into the bucket -1.
    """
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    c = np.where((chars >= 65) & (chars <= 90), chars + np.uint32(32), chars)
    n = len(c)
    out = np.full((n, 2), -1, np.int32)
    if n > 1:
        two = (c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)) ^ np.uint32(0x27D4EB2F)
        out[:-1, 0] = (two * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    if n > 2:
        three = c[:-2] * np.uint32(0xC2B2AE3D) + c[1:-1] * np.uint32(0x165667B1) + c[2:] * np.uint32(0x9E3779B1)
        out[:-2, 1] = (three * np.uint32(0x297A2D39)) >> np.uint32(16)
    ends = starts[1:]
    last, last2 = ends - 1, ends - 2
    out[last[last >= 0]] = -1
    out[last2[last2 >= 0], 1] = -1
    return c, out.reshape(-1), starts * 2


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each document's run of values; an empty run is 0."""
    if not len(values):
        return np.zeros(len(starts) - 1)
    padded = np.append(values, 0)
    out = np.add.reduceat(padded, starts[:-1], dtype=np.float64)
    return np.where(starts[1:] > starts[:-1], out, 0.0)


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Learn from rows with a language; about ``rows_per_language`` of each are read.

    The rows are taken by a hash of the id, so reruns agree.  Counts come back
    summed per language and bucket.  Without a labelled row the model has no
    language.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    counted = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counted:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    languages = [x for x, _ in counted]
    share = F.create_map(*[F.lit(x) for lang, n in counted for x in (lang, min(1.0, rows_per_language / n))])
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(u < F.element_at(share, F.col("lang"))).select("lang", "text")
    at = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(at), BUCKETS), np.int64)
        for batch in batches:
            where = np.array([at[x.as_py()] for x in batch.column(0)], np.int64)
            for a, b, raw, off in text_slices(batch.column(1), _SLICE):
                _, grams, starts = _grams(raw, off)
                who = np.repeat(where[a:b], np.diff(starts))
                keep = grams >= 0
                total += np.bincount(who[keep] * BUCKETS + grams[keep], minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = map_arrow(sample, count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.ones((len(languages), BUCKETS))
    seen[counts["lang"].to_numpy(), counts["bucket"].to_numpy()] += counts["n"].to_numpy()
    prior = np.array([n for _, n in counted], float)
    return Model(languages, np.log(seen / seen.sum(1, keepdims=True)).astype(np.float32), np.log(prior / prior.sum()))


def _score(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    names, scores = [], []
    for _, _, raw, off in text_slices(texts, _SLICE):
        chars, grams, starts = _grams(raw, off)
        #: the extra column takes the entries without a gram
        table = np.concatenate([model.log_prob, np.zeros((len(model.languages), 1), np.float32)], axis=1)
        total = np.stack([_sums(row[grams], starts) for row in table], axis=1) + model.log_prior if model.languages else None
        plain = _sums(np.repeat((chars >= 97) & (chars <= 122), 2).astype(np.int8), starts) > 0
        for i, letter in enumerate(plain):
            if not letter:
                own = chars[starts[i] // 2 : starts[i + 1] // 2]
                letter = any(chr(c).isalpha() for c in np.unique(own))
            if not letter or total is None:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            t = total[i] - total[i].max()
            names.append(model.languages[int(np.argmax(t))])
            scores.append(float(1.0 / np.exp(t).sum()))
    return names, scores


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1, the posterior) added.

    The whole text is scored.  A null text or one without a letter: ``und``,
    score 0, as is everything when the model has no language; a letter too
    short to have a gram gets the prior's language.  Ties go to the language
    first in code point order.  Rows are worked on one by one: repeated rows
    stay, an empty table stays empty, columns of the same names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            lang, score = _score(held.value, batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(crc_mod("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
