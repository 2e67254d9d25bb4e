"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where none is set, one of our own if all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    With ``tidy``, the driver then collects its garbage: Spark deletes the
    shuffle files of finished queries when their plans are collected, which
    else may be much later.  Worth it where much was shuffled.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    if tidy:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what :func:`staged` wrote, when nothing reads it any more."""
    path = getattr(df, "staged_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _staged[:] = [x for x in _staged if x[1] != path]


@atexit.register
def _sweep() -> None:
    for spark, path in list(_staged):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the shared folder's owner cleans up
            return
