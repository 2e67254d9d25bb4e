"""Phrases whose words stand together far more often than their parts would by chance."""

from __future__ import annotations

import hashlib
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import map_arrow, staged, table, text_slices
from .shingles import LOWER, mixed, span_hashes, word_spans

#: Words of the longest phrase, occurrences of a candidate, phrases reported per language.
LONGEST, LEAST, TOP = 5, 100, 2000
#: A candidate goes if a longer one has so many per cent of its occurrences.
SHARE = 100
UNKNOWN = "und"
#: The filter of frequent words and pairs has so many bits (powers of two) at least and at most; a fuller one lets more through, never less.
LEAST_BITS, MOST_BITS = 16, 28
#: A key that many rows may share is dealt to so many parts.
SALTS = 16
#: Bytes of text that a task looks at together, about.
SLICE = 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_PAIR = np.uint64(0xD6E8FEB86659FD93)


# -- words and pairs of texts ----------------------------------------------------------


class Tokens:
    """The words of texts of one language laid end to end: spans, keys, and which two neighbours share a piece."""

    def __init__(self, lang: str, raw: np.ndarray, offsets: np.ndarray):
        self.raw = raw
        self.starts, self.ends = word_spans(raw, offsets, _APART)
        hashes = span_hashes(raw, self.starts, self.ends)
        own = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        piece = np.cumsum(_BREAK[raw])[self.starts] if len(raw) else self.starts
        text = np.searchsorted(offsets, self.starts, "right")
        self.linked = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        self.words = mixed(hashes ^ own)
        self.pairs = mixed((hashes[:-1] * _PAIR + hashes[1:]) ^ own)


def of_languages(batch: pa.RecordBatch):
    """(language, tokens of a slice of its texts) of a batch of (lang, text)."""
    langs = batch.column(0).dictionary_encode()
    which = langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        for _, _, raw, offsets in text_slices(batch.column(1).take(pa.array(np.flatnonzero(which == i))), SLICE):
            yield lang, Tokens(lang, raw, offsets)


def key_counts(batches):
    """Rows (lang, null, words of a slice) and (null, key, occurrences in a slice) for words and pairs."""
    for batch in batches:
        for lang, t in of_languages(batch):
            keys, n = np.unique(np.concatenate([t.words, t.pairs[t.linked]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "key", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.int64()), pa.array([len(t.words)])], names=["lang", "key", "n"])


class Frequent:
    """A set of 64-bit keys as two bits each; it may hold more, never less."""

    def __init__(self, bits: int, masks: np.ndarray):
        self.bits, self.masks = bits, masks

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            bit = (keys >> np.uint64(shift)) & np.uint64(self.bits - 1)
            out &= (self.masks[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
        return out


def frequent_keys(counted: DataFrame) -> Frequent:
    """The keys of ``counted`` as a filter of at most 2 ** MOST_BITS bits, which is all the driver sees."""
    keys = counted.where(F.col("key").isNotNull()).select("key")
    size = min(MOST_BITS, max(LEAST_BITS, (16 * keys.count()).bit_length()))
    both = F.array(F.col("key"), F.shiftrightunsigned("key", 32))
    bit = keys.select(F.explode(both).alias("bit")).select(F.col("bit").bitwiseAND((1 << size) - 1).alias("bit"))
    mask = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    found = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(mask).alias("mask")).toArrow()
    masks = np.zeros(1 << (size - 6), np.uint64)
    masks[found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return Frequent(1 << size, masks)


def runs_of(t: Tokens, frequent: Frequent) -> pa.StringArray:
    """The runs of words, joined by one space, that are left when pieces are cut at rare words and between the words of rare pairs."""
    keep = frequent.has(t.words)
    bond = t.linked & keep[:-1] & keep[1:]
    at = np.flatnonzero(bond)
    bond[at] = frequent.has(t.pairs[at])
    kept = np.flatnonzero(keep)
    ends_run = np.append(~bond, True)[kept]
    length = t.ends[kept] - t.starts[kept] + ~ends_run
    edge = np.concatenate([[0], np.cumsum(length)])
    out = LOWER[t.raw[np.minimum(np.arange(edge[-1]) + np.repeat(t.starts[kept] - edge[:-1], length), max(len(t.raw) - 1, 0))]] if edge[-1] else np.zeros(0, np.uint8)
    out[edge[1:][~ends_run] - 1] = 0x20
    offsets = np.concatenate([[0], edge[1:][ends_run]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))


# -- counts -----------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a) of every phrase of 1 to ``longest`` words seen ``least`` times or more, (lang, n) of every language).

    All n-grams are exploded into rows and hash-aggregated per language, but
    for those that cannot reach ``least``: a first pass counts words and pairs
    of words by a 64-bit key, and texts are cut where a word or a pair falls
    short.  Keys that meet only add to a count, so no phrase is lost by it,
    and what is left of a frequent phrase is every one of its occurrences.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = map_arrow(texts, key_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    counted = staged(counted.where(F.col("key").isNull() | (F.col("n") >= least)), tidy=True)
    held = docs.sparkSession.sparkContext.broadcast(frequent_keys(counted))

    def runs(batches):
        for batch in batches:
            for lang, t in of_languages(batch):
                seen = pc.value_counts(runs_of(t, held.value))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), seen.field("values"), seen.field("counts")], names=["lang", "run", "copies"])

    words = map_arrow(texts, runs, "lang string, run string, copies long").select("lang", F.split("run", " ").alias("words"), "copies")
    grams = words.select("lang", F.explode(ngrams(F.col("words"), longest)).alias("phrase"), "copies")
    counts = grams.groupBy("lang", "phrase").agg(F.sum("copies").alias("a")).where(F.col("a") >= least)
    counts = staged(counts.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "a"), tidy=True)
    return counts, counted.where(F.col("key").isNull()).select("lang", "n")


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` words, each joined by one space."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda at: F.array_join(F.slice(words, at, n), " "))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(longest))), of))


# -- scores -----------------------------------------------------------------------------


def dealt(words: Column, phrase: str) -> Column:
    """The part of a short phrase's rows that a longer phrase belongs to; long ones have few rows and one part."""
    return F.when(words <= 2, F.pmod(F.xxhash64(phrase), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))


def parts_of(words: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.when(words <= 2, F.lit(SALTS - 1)).otherwise(F.lit(0))))


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every phrase of two words or more.

    Score: floor(1000 a n / (l r)) of the cut that scores least, in decimals of
    38 digits, so products past 64 bits are exact.  Words and pairs, which many
    phrases begin or end with, are dealt to SALTS parts.
    """
    salted = totals.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    longer = counts.where(F.col("words") >= 2).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    split = F.split("phrase", " ")
    cuts = longer.select("lang", "phrase", "words", "a", "n", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(split, F.col("k") + 1, F.col("words")), " "))
    for part, size, count in (("first", F.col("k"), "l"), ("rest", F.col("words") - F.col("k"), "r")):
        known = counts.select("lang", F.col("phrase").alias(part), F.col("a").alias(count), parts_of(F.col("words")).alias("salt"))
        cuts = cuts.withColumn("salt", dealt(size, "phrase")).join(known, ["lang", part, "salt"]).drop("salt")
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("above", (exact["a"] * exact["n"] * F.lit(1000)).cast("decimal(38,0)")).withColumn("below", (exact["l"] * exact["r"]).cast("decimal(38,0)"))
    cut = F.struct(F.expr("above div below").cast("long").alias("score"), "k", "words", "a", "l", "r", "n")
    return cuts.groupBy("lang", "phrase").agg(F.min(cut).alias("cut")).select("lang", "phrase", "cut.words", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def without_parts(phrases: DataFrame, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """``phrases`` but those inside a longer one with ``share`` per cent of their occurrences.

    Extensions by one word suffice: what lies between a phrase and a longer
    one is at least as frequent as the longer one.
    """
    longer = counts.where(F.col("words") >= 3)
    split = F.split("phrase", " ")
    shorter = F.array(F.array_join(F.slice(split, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(split, F.lit(2), F.col("words") - 1), " "))
    extended = longer.select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    gone = (phrases["lang"] == extended["lang"]) & (phrases["phrase"] == extended["phrase"]) & (extended["most"] * 100 >= phrases["a"] * share)
    return phrases.join(extended, gone, "left_anti")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, share: int = SHARE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases by score, a, then phrase.

    A-Z are lowered; punctuation and line ends part pieces, blanks and tabs
    words.  Null texts are empty, null languages ``und``, repeated rows count
    again.  A table without a frequent phrase, or empty, gives no row.  Other
    columns are not looked at.  Each part of a language is cut to its first
    ``top`` before the language is ranked, so no task sees a language whole.
    """
    counts, totals = phrase_counts(docs, longest, least, lang_col, text_col)
    left = without_parts(scored(counts, totals), counts, share).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", "salt"], ["lang"]):
        left = left.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return left.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
    SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
    SELECT lang, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM worded, range(1, 6) r(k)
), counts AS (
    SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
    SELECT lang, k, phrase, a, unnest(range(1, k)) AS c FROM counts WHERE k >= 2
), scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, f.a AS l, g.a AS r, n, c.c, (1000::HUGEINT * c.a * n) // (f.a::HUGEINT * g.a) AS score
    FROM cuts c JOIN totals t ON t.lang = c.lang
    JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(string_split(c.phrase, ' ')[1 : c.c], ' ')
    JOIN counts g ON g.lang = c.lang AND g.phrase = array_to_string(string_split(c.phrase, ' ')[c.c + 1 : c.k], ' ')
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), left_over AS (
    SELECT * FROM lowest x WHERE NOT EXISTS (
        SELECT 1 FROM counts y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM left_over QUALIFY rank <= 2000
"""
