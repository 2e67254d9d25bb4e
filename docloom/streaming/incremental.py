"""Streams: extensions beyond batch runs.

The batch rules have no watermarks or windows; what is here keeps their tables
up to date from a stream of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import scenario, snapshot


def event_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """(window, by, n, value) per tumbling window; rows later than the watermark are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def water_rate(events: DataFrame, scenario_name: str = "mid", late: str = "1 hour", width: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Millilitres per window, one request an event."""
    ml = dict(scenario.SCENARIOS)[scenario_name]
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, late).groupBy(F.window(ts, width)).agg((F.count("*") * F.lit(ml)).alias("ml"))


TICKS_OUT = "key string, ticks long, last long"


def catch_up_ticks(rows: DataFrame, period_ms: int, key: str = "key", now_ms: str = "now_ms") -> DataFrame:
    """(key, ticks, last) per batch and key: whole periods since the last tick, which moves on by them.

    The first row of a key starts its clock.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = max(int(f["now_ms"].max()) for f in frames)
        last = state.get[0] if state.exists else latest
        n = max(0, (latest - last) // period_ms)
        last += n * period_ms
        state.update((last,))
        yield pd.DataFrame({"key": [k[0]], "ticks": [n], "last": [last]})

    named = rows.select(F.col(key).cast("string").alias("key"), F.col(now_ms).cast("long").alias("now_ms"))
    return named.groupBy("key").applyInPandasWithState(step, TICKS_OUT, "last long", "update", GroupStateTimeout.NoTimeout)


def keep_merged(stream: DataFrame, target: str, key: str, version: str, checkpoint: str):
    """A query that keeps one row per key, the newest, in the tables ``target``/<batch>; the newest folder counts.

    A batch that is run again writes the same folder, so a restart changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = snapshot.merged(batch.limit(0), batch, key, version)
        if number:
            new = snapshot.merged(spark.read.parquet(f"{target}/{number - 1}"), batch, key, version)
        new.write.mode("overwrite").parquet(f"{target}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
