"""Texts of a folder's files, read again only where a file has changed."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from .progress import Progress
from .publication import Store
from .staging import staged

#: Changed files that are opened by their paths; where more have changed, the whole folder is read.
BY_PATH = 10_000
KEY = ["relative_path", "size", "modified"]


def cache_name(root: str) -> str:
    """The name of a folder's store: the same for the same folder, with or without a slash at its end."""
    return hashlib.sha256(root.rstrip("/").encode()).hexdigest()[:16]


def extracted(scanned: DataFrame, root: str, cache: str, progress: Progress | None = None) -> DataFrame:
    """What :func:`files.extracted` gives for the files that count, out of the store below ``cache`` where path, size and time are known.

    The store is written anew with the files that are there now, so it holds
    no gone ones, and is published whole: a run that crashes leaves the last
    one.  ``progress`` tells how many files were opened.
    """
    progress = progress or Progress()
    spark = scanned.sparkSession
    store = Store(spark, f"{cache.rstrip('/')}/{cache_name(root)}")
    known = store.current()
    wanted = scanned.where("skip is null")
    if known is None:
        changed, fresh = None, files.extracted(scanned)
    else:
        old = spark.read.parquet(known)
        changed = staged(wanted.select("path", *KEY).join(old.select(*KEY), KEY, "left_anti"))
        few = changed.limit(BY_PATH + 1).select("path").collect()
        if len(few) > BY_PATH:
            fresh = files.extracted(wanted.join(changed.select("path"), "path", "left_semi"))
        elif few:
            opened = spark.read.format("binaryFile").load([r["path"] for r in few]).select("path", "content")
            fresh = files.extracted(opened.join(wanted.drop("content"), "path"))
        else:
            fresh = old.limit(0)
    fresh = progress.watch("opened", fresh, bytes=F.coalesce(F.sum("size"), F.lit(0)))
    if known is None:
        rows = fresh
    else:
        rows = old.join(wanted.select(*KEY), KEY, "left_semi").select(*fresh.columns).unionByName(fresh)
    now = store.publish(lambda folder: rows.write.parquet(folder))
    progress.done("opened")
    store.clean(keep=2)
    return spark.read.schema(rows.schema).parquet(now)
