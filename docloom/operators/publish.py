"""Whether a new package may replace the published one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_RATIO = 0.5


def published_chunks(indexes: DataFrame) -> DataFrame:
    """Sum of the counts in the index files of a package (column text); null if no file has one."""
    n = F.regexp_extract(F.col("text"), r"(?m)^SourceChunkCount:\s*(\d+)\s*$", 1)
    return indexes.select(F.nullif(n, F.lit("")).cast("long").alias("n")).agg(F.sum("n").alias("previous_chunks"))


def decide(rows: DataFrame, force: Column, stopped: Column, had_source: Column, previous: Column, new: Column, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """rows with ``publish`` and ``reason``; the first rule that applies decides."""
    reason = (
        F.when(force, "forced").when(stopped, "hold: stopped").when(~had_source, "hold: no source").when(previous.isNull(), "first run")
        .when((previous > 0) & (new == 0), "hold: no chunks").when((previous > 0) & (new / F.nullif(previous, F.lit(0)) < least_ratio), "hold: too few chunks").otherwise("ok")
    )
    return rows.withColumn("reason", reason).withColumn("publish", ~F.col("reason").startswith("hold"))
