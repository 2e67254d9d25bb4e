"""Water behind requests: scenarios, comparisons, vessels, and a counter that never jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Millilitres per request, what volumes are compared with, and the vessels with how often each is drawn at most.
SCENARIOS = [("low", 0.26), ("mid", 45.0), ("high", 519.0)]
COMPARISONS = [("spoon", 5.0, True), ("coffee", 150.0, False), ("bottle", 500.0, True), ("shower", 12000.0, True), ("bath", 200000.0, False), ("pool", 390e6, False), ("dome", 1.24e12, True)]
VESSELS = [("bottle", 500.0, 48), ("bottle2", 2000.0, 48), ("case", 12000.0, 48), ("bath", 200000.0, 120), ("pool", 390e6, 48), ("dome", 1.24e12, 12)]
PROMPTS_PER_DAY = 2.5e9
NOT_TELLING = ("dome", "pool")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"rank int, {schema}"))


def scenarios(spark: SparkSession) -> DataFrame:
    return _rows(spark, SCENARIOS, "scenario string, ml_per_prompt double").drop("rank")


def comparisons(spark: SparkSession) -> DataFrame:
    return _rows(spark, COMPARISONS, "comparison string, comparison_ml double, verified boolean")


def vessels(spark: SparkSession) -> DataFrame:
    return _rows(spark, VESSELS, "vessel string, vessel_ml double, max_copies int")


def rate_lps(ml_per_prompt: Column, prompts_per_day: Column) -> Column:
    return prompts_per_day * ml_per_prompt / 1000 / 86400


def most_telling(rows: DataFrame, ml: str, key: list[str]) -> DataFrame:
    """rows with the largest comparison that fits into the volume once, the smallest if none does."""
    dims = comparisons(rows.sparkSession).where(~F.col("comparison").isin(*NOT_TELLING))
    every = dims.select("rank", "comparison", "comparison_ml", "verified")
    joined = rows.join(every, (F.col(ml) / F.col("comparison_ml") >= 1) | (F.col("rank") == 0))
    picked = joined.groupBy(*key).agg(F.max(F.struct("rank", "comparison", "comparison_ml", "verified")).alias("x"), F.first(ml).alias(ml))
    return picked.select(*key, ml, "x.comparison", (F.col(ml) / F.col("x.comparison_ml")).alias("times"), "x.verified")


def vessel_stage(rows: DataFrame, ml: str, key: list[str]) -> DataFrame:
    """rows with the first vessel that needs at most its number of copies, the last if all need more."""
    dims, last = vessels(rows.sparkSession), len(VESSELS) - 1
    copies = F.ceil(F.col(ml) / F.col("vessel_ml"))
    joined = rows.join(dims, (copies <= F.col("max_copies")) | (F.col("rank") == last))
    picked = joined.groupBy(*key).agg(F.min(F.struct("rank", "vessel", "vessel_ml")).alias("x"), F.first(ml).alias(ml))
    return picked.select(*key, ml, "x.vessel", F.ceil(F.col(ml) / F.col("x.vessel_ml")).alias("copies"))


def ladder(per_day: DataFrame, people: DataFrame, days: DataFrame) -> DataFrame:
    """Every combination of a few values with every scenario: the volume in millilitres.

    Tables of settings, a handful of rows each.
    """
    every = per_day.crossJoin(people).crossJoin(days).crossJoin(scenarios(per_day.sparkSession))
    return every.withColumn("ml", F.col("per_day") * F.col("people") * F.col("days") * F.col("ml_per_prompt"))


def running_total(switches: DataFrame, key: list[str], end: Column, ts: str = "ts", rate: str = "rate", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """(key, total) where each row sets a rate that holds until the next one, the last until ``end``.

    The total is continuous at every switch.
    """
    until = F.coalesce(F.lead(ts).over(W.partitionBy(*key).orderBy(*order)), end)
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    seconds = (micros(until) - micros(F.col(ts))) / 1e6
    return switches.withColumn("litres", seconds * F.col(rate)).groupBy(*key).agg(F.sum("litres").alias("total"))


def _decimals(v: Column) -> Column:
    a = F.abs(v)
    return F.when(F.abs(a - F.round(a)) < 1e-9, 0).when(a < 10, 2).when(a < 100, 1).otherwise(0)


def fixed(v: Column, decimals: Column) -> Column:
    """Grouped by thousands, with just these decimals (0 to 3); halves away from zero."""
    to = lambda d: F.format_number(F.signum(v) * F.floor(F.abs(v) * 10**d + F.lit(0.5)) / 10**d, d)
    return F.when(decimals == 0, to(0)).when(decimals == 1, to(1)).when(decimals == 2, to(2)).otherwise(to(3))


def volume_text(ml: Column) -> Column:
    l = ml / 1000  # noqa: E741
    v = F.when(ml < 1000, ml).when(l < 1e4, l).when(l < 1e8, l / 1e4).when(l < 1e12, l / 1e8).otherwise(l / 1e12)
    unit = F.when(ml < 1000, "mL").when(l < 1e4, "L").when(l < 1e8, "万 L").when(l < 1e12, "億 L").otherwise("兆 L")
    return F.concat(fixed(v, _decimals(v)), F.lit(" "), unit)


def count_text(n: Column) -> Column:
    a = F.abs(n)
    big = lambda v, u: F.concat(fixed(v, F.when((v < 100) & (F.abs(v - F.round(v)) > 1e-9), 1).otherwise(0)), F.lit(u))
    return F.when(a < 1e4, fixed(n, F.when(n == F.floor(n), 0).otherwise(_decimals(n)))).when(a < 1e8, big(n / 1e4, "万")).when(a < 1e12, big(n / 1e8, "億")).otherwise(big(n / 1e12, "兆"))


def times_text(x: Column) -> Column:
    whole = F.abs(x - F.round(x)) < 1e-9
    return F.when(x >= 100, count_text(F.round(x))).when(whole, fixed(x, F.lit(0))).when(x >= 10, fixed(x, F.lit(1))).when(x >= 0.01, fixed(x, F.lit(2))).otherwise(fixed(x, F.lit(3)))


def duration_text(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def log_position(value: Column, low: float, high: float) -> Column:
    """0 to 1 on a logarithmic scale."""
    return (F.log10(value) - F.log10(F.lit(low))) / (F.log10(F.lit(high)) - F.log10(F.lit(low)))


def from_log_position(p: Column, low: float, high: float) -> Column:
    return F.pow(F.lit(10.0), F.log10(F.lit(low)) + p * (F.log10(F.lit(high)) - F.log10(F.lit(low))))


def catch_up(now: Column, last: Column, period_ms: int) -> Column:
    """(n, last): whole periods since the last tick, and the tick moved on by them."""
    n = F.floor((now - last) / period_ms).cast("long")
    return F.struct(n.alias("n"), (last + n * period_ms).alias("last"))
