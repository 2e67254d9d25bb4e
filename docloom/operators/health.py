"""How well a collection can be used: coverage, age, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READABLE, STALE_YEARS = ("ok", "partial"), 3


def status_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))


def coverage(outcomes: DataFrame) -> DataFrame:
    """Units read over units there, of rows that have units; null if none has."""
    with_units = F.col("units_total") > 0
    ok, total = F.sum(F.when(with_units, F.col("units_ok"))), F.sum(F.when(with_units, F.col("units_total")))
    return outcomes.agg(ok.alias("units_ok"), total.alias("units_total"), F.when(total > 0, ok / total).alias("coverage"))


def extension_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def age_bucket(modified: Column, today: Column) -> Column:
    """Whole days over 365.25: up to a year, up to three, more; unknown without a time."""
    years = F.floor((F.unix_timestamp(today.cast("timestamp")) - F.unix_timestamp(modified)) / 86400) / 365.25
    return F.when(modified.isNull(), "unknown").when(years < 1, "under_1").when(years < STALE_YEARS, "under_3").otherwise("over_3")


def grade(total: Column) -> Column:
    return F.when(total >= 85, "A").when(total >= 70, "B").when(total >= 50, "C").otherwise("D")


def health_score(outcomes: DataFrame, today: Column, duplicated: Column, overflow: Column, findings: Column) -> DataFrame:
    """One row: five scores, total and grade.

    ``outcomes`` has status and modified.  The other arguments are numbers:
    superfluous copies, chunks left over, sensitive values found.  Halves round
    to even.
    """
    bucket = age_bucket(F.col("modified"), today)
    total, readable = F.greatest(F.count("*"), F.lit(1)), F.count_if(F.col("status").isin(*READABLE))
    fresh, unknown = F.count_if(bucket.isin("under_1", "under_3")), F.count_if(bucket == "unknown")
    dated = total - unknown
    sums = outcomes.agg(
        F.bround(40 * readable / total).cast("int").alias("readable"),
        F.when(dated > 0, F.bround(20 * fresh / dated)).otherwise(20).cast("int").alias("freshness"),
        F.bround(15 * F.greatest(F.lit(0.0), 1 - duplicated / total)).cast("int").alias("uniqueness"),
    )
    sums = sums.withColumn("capacity", F.when(overflow > 0, 0).otherwise(15)).withColumn("safety", F.when(findings > 0, 4).otherwise(10))
    out = sums.withColumn("total", F.col("readable") + F.col("freshness") + F.col("uniqueness") + F.col("capacity") + F.col("safety"))
    return out.withColumn("grade", grade(F.col("total")))


def todo(score: DataFrame) -> DataFrame:
    """(part, points, most) of the parts that lost points, worst first."""
    most = {"readable": 40, "freshness": 20, "uniqueness": 15, "capacity": 15, "safety": 10}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(k).alias("points"), F.lit(m).alias("most")) for k, m in most.items()]))
    return score.select(parts.alias("x")).select("x.*").where("points < most").orderBy(F.desc(F.col("most") - F.col("points")), "part")


def first_rows(rows: DataFrame, order: list, most: int = 100) -> DataFrame:
    """The first rows of a section, with how many more there are."""
    n = rows.count()
    return rows.orderBy(*order).limit(most).withColumn("more", F.lit(max(0, n - most)))
