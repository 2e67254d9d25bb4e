"""What has changed between runs, and what earlier runs can still give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def diff(previous: DataFrame, current: DataFrame, key: str = "path", values: tuple[str, ...] = ("size", "mtime")) -> DataFrame:
    """(key, change): added, changed or removed; equal rows are left out."""
    p = previous.select(F.col(key).alias("p_key"), F.struct(*values).alias("p_values"))
    c = current.select(F.col(key).alias("c_key"), F.struct(*values).alias("c_values"))
    change = F.when(F.col("p_key").isNull(), "added").when(F.col("c_key").isNull(), "removed").when(~F.col("p_values").eqNullSafe(F.col("c_values")), "changed")
    both = p.join(c, F.col("p_key") == F.col("c_key"), "full")
    return both.select(F.coalesce("c_key", "p_key").alias(key), change.alias("change")).where("change is not null")


def diff_of_runs(inventory: DataFrame, run: int, **kw) -> DataFrame:
    """The diff of a run against the one right before it; no rows without one."""
    before = inventory.where(F.col("run_id") < run).agg(F.max("run_id")).first()[0]
    now = inventory.where(F.col("run_id") == run)
    return diff(inventory.where(F.col("run_id") == (before if before is not None else run)), now, **kw)


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files with what the cache holds for the same path, size and time, and ``hit``."""
    known = cache.withColumn("hit", F.lit(True))
    return files.join(known, ["path", "size", "mtime"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def cache_without_gone(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    return cache.join(inventory.select("path"), "path", "left_semi")


def last_runs(runs: DataFrame, keep: int = 5, by: str = "run_id") -> DataFrame:
    """The latest runs (also logs or sessions, by what orders them)."""
    return runs.orderBy(F.desc(by)).limit(keep)


def merged(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the new one where there are both; stands in for MERGE."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("is_new"), F.desc(version)))
    both = old.withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)))
    return both.withColumn("nth", rank).where("nth = 1").drop("nth", "is_new")


def upload_note(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(file_name, state): new, changed, unchanged or removed by the hash of the content."""
    p, c = previous.select("file_name", F.col("sha").alias("p_sha")), current.select("file_name", F.col("sha").alias("c_sha"))
    state = F.when(F.col("p_sha").isNull(), "new").when(F.col("c_sha").isNull(), "removed").when(F.col("p_sha") == F.col("c_sha"), "unchanged").otherwise("changed")
    return p.join(c, "file_name", "full").select("file_name", state.alias("state"))


def save_state(current: DataFrame, path: str) -> None:
    """The state of this run in place of the one before."""
    current.select("file_name", "sha").write.mode("overwrite").parquet(path)
