"""Documents resampled towards a target's distribution of hashed word features."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import staged, table

#: Buckets that features are hashed to, and words of the longest feature.
BUCKETS, LONGEST = 10_000, 1
#: Documents with fewer words are not drawn; of the others so many per cent are.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: A text with more than one row in so many joins by a broadcast; there are fewer such texts than this number.
HEAVY = 1000
#: What parts words, once A-Z are lowered: ASCII but digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, BETWEEN), "")  # one pass; extracting match by match is several times slower


def buckets_of(words: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``longest`` consecutive words, repeats included."""
    bucket = lambda run: (F.crc32(run.cast("binary")) % buckets).cast("int")

    def of_length(n: int) -> Column:
        if n == 1:
            return F.transform(words, bucket)
        places = F.slice(F.sequence(F.lit(1), F.size(words) + 1), F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        return F.transform(places, lambda at: bucket(F.array_join(F.slice(words, at, F.lit(n)), " ")))

    return F.concat(*[of_length(n) for n in range(1, longest + 1)]) if longest > 1 else of_length(1)


def featured(docs: DataFrame, longest: int, buckets: int, text_col: str) -> DataFrame:
    """(key, copies, n_words, buckets) of every distinct text.

    Grouping by the full text collapses copies before the shuffle, so a text
    that fills a third of the table crosses it once per task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    distinct = docs.groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    words = distinct.select(text_key("text").alias("key"), "copies", words_of(F.col("text")).alias("words"))
    return staged(words.select("key", "copies", F.size("words").alias("n_words"), buckets_of(F.col("words"), longest, buckets).alias("buckets")))


def text_key(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def bucket_counts(features: DataFrame, buckets: int) -> list[int]:
    """How many features of all rows fall into each bucket; the driver sees ``buckets`` numbers."""
    each = features.select("copies", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("copies").alias("n"))
    out = [0] * buckets
    for r in each.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln(target share / raw share)) of each bucket, shares smoothed by one feature a bucket."""
    s_all, t_all = float(sum(raw) + len(raw)), float(sum(target) + len(raw))
    return [math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(raw, target)]


def noise(id_col: str, seed: int) -> Column:
    """A Gumbel number in thousandths that the id and the seed decide; a null id counts as the empty text."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(share))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row.

    Features are computed once per distinct text and counted with its copies;
    the weight is the sum of the gains of a text's features.  Weights return
    to the rows by the text's SHA-256: texts with more than one row in HEAVY
    (fewer than HEAVY of them) by a broadcast, all others by a join in which
    no key holds more rows than that.
    """
    features = featured(docs, longest, buckets, text_col)
    gain = gains(bucket_counts(features, buckets), bucket_counts(featured(target, longest, buckets, target_col), buckets))
    of_bucket = F.split(F.lit(" ".join(map(str, gain))), " ").cast("array<bigint>")  # folded to one literal array
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.get(of_bucket, b))
    weights = features.select("key", "copies", F.struct(F.col("n_words").cast("long").alias("n_words"), F.size("buckets").cast("long").alias("n_features"), weight.alias("weight")).alias("of"))

    rows = features.agg(F.sum("copies")).first()[0] or 0
    heavy = weights.where(F.col("copies") * HEAVY > rows).select("key", F.col("of").alias("heavy"))
    light = weights.where(F.col("copies") * HEAVY <= rows).select(F.col("key").alias("to"), F.col("of").alias("light"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key")).join(F.broadcast(heavy), "key", "left")
    #: rows that are answered keep a key of their own, which meets no text's
    own = F.concat(F.lit("-").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    joined = keyed.withColumn("to", F.when(F.col("heavy").isNull(), F.col("key")).otherwise(own)).join(light, "to", "left")
    return joined.select("doc_id", F.coalesce("heavy", "light").alias("of")).select("doc_id", "of.*")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; a null rank is not drawn.

    Score: weight plus noise of the row's own id.  Of the rows with at least
    ``least_words`` words, ``percent`` per cent with the highest scores are
    drawn, ties to the smaller id (null first); ranks are the place in that order, found in
    range partitions of (score, id) from the counts of the ranges before.

    Null and empty texts have no features, weight 0, and are never drawn.
    Repeated rows stay, each with a rank of its own.  An empty table gives an
    empty one; an empty target draws by the features that are rarest in
    ``docs``.  Other columns of ``docs`` are not looked at.
    """
    scored = staged(weighed(docs, target, longest, buckets, id_col, text_col, target_col).withColumn("score", F.col("weight") + noise("doc_id", seed)))
    columns = ["doc_id", "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc("doc_id")]
    in_order = scored.where(F.col("n_words") >= least_words).select(*columns).repartitionByRange(*order)
    ranged = staged(in_order.withColumn("part", F.spark_partition_id()))

    spark, before, at = docs.sparkSession, [], 0
    for r in sorted(ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one number per range
        before.append((r["part"], at))
        at += r["n"]
    drawn = percent * at // 100
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    place = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*order))
    ranked = ranged.join(offsets, "part").withColumn("place", place).select(*columns, F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH crc AS (
    SELECT list_transform(range(256), lambda v: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, v)) AS steps
), all_words AS (
    SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
    UNION ALL
    SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), bucketed AS (
    SELECT word, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT),
                                             lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
    FROM (SELECT DISTINCT word FROM all_words), crc
), features AS (
    SELECT side, id, bucket FROM all_words JOIN bucketed USING (word)
), counted AS (
    SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM features GROUP BY bucket
), gained AS (
    SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counted) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000))))::BIGINT AS gain FROM counted
), weights AS (
    SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM features JOIN gained USING (bucket) WHERE side = 'd' GROUP BY id
), scored AS (
    SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
           coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN weights ON id = doc_id
), placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""
