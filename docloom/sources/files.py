"""Folders of files as tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.ordering import numbered
from . import readers

# What a scan leaves out.
TEMP_PREFIXES, TEMP_NAMES = ("~$", ".~"), (".DS_Store", "Thumbs.db", "desktop.ini")
EXCLUDED_DIRS = ("ChatGPT用コンテキストファイル生成", "収集データ", "生成コンテキスト", "管理")
OWN_PREFIX = "_AI_CONTEXT_"
CLOUD_ONLY = 0x1000 | 0x40000 | 0x400000


def is_temp(name: Column) -> Column:
    out = name.isin(*TEMP_NAMES)
    for p in TEMP_PREFIXES:
        out = out | name.startswith(p)
    return out


def is_target(path: Column, extensions: tuple[str, ...] = readers.TARGETS) -> Column:
    return tx.extension(path).isin(*extensions)


def in_excluded(path: Column, names: tuple[str, ...] = EXCLUDED_DIRS) -> Column:
    """Whether a folder above the file has one of the names."""
    folders = F.split(F.regexp_replace(path, "/[^/]*$", ""), "/")
    return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))


def is_cloud_only(attributes: Column) -> Column:
    """Whether a file's attributes mark it as a placeholder for one that is elsewhere."""
    return attributes.bitwiseAND(F.lit(CLOUD_ONLY)) != 0


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, modified, content) of all files below the root; content is read only if used.

    Spark itself never lists names that begin with ``_`` or ``.``.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


def relative_to(path: Column, root: str) -> Column:
    """The path below the root, whatever the scheme in front of it; the name alone if it is elsewhere."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(tx.base_name(plain))


def scan(files: DataFrame, root: str, skip_temp: bool = True, excluded: tuple[str, ...] = EXCLUDED_DIRS, cloud: str = "download") -> DataFrame:
    """Files with relative_path, extension and ``skip``: why a file is left out, null for those that count."""
    rel = relative_to(F.col("path"), root)
    name = tx.base_name(F.col("relative_path"))
    reason = F.when(in_excluded(F.col("relative_path"), excluded), "excluded").when(~is_target(F.col("relative_path")), "extension").when(name.startswith(OWN_PREFIX), "own")
    if skip_temp:
        reason = reason.when(is_temp(name), "temp")
    if cloud == "skip" and "attributes" in files.columns:
        reason = reason.when(is_cloud_only(F.col("attributes")), "cloud")
    return files.withColumn("relative_path", rel).withColumn("extension", tx.extension(F.col("relative_path"))).withColumn("skip", reason)


def scan_counts(scanned: DataFrame) -> DataFrame:
    """(extension, n_files, bytes) of the files that count."""
    return scanned.where("skip is null").groupBy("extension").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


OUTCOME = "text string, status string, reason string, units_total int, units_ok int, failures array<struct<label:string,reason:string>>, meta map<string,string>"


def extracted(files: DataFrame) -> DataFrame:
    """relative_path, extension, size, modified and what the reader of each file gives."""
    kept = ["relative_path", "extension", "size", "modified"]

    def run(batches):
        for batch in batches:
            got = [readers.extract(raw.as_py() or b"", path.as_py()) for raw, path in zip(batch.column("content"), batch.column("relative_path"))]
            cols = [pa.array([g.text for g in got], pa.string()), pa.array([g.status for g in got], pa.string()), pa.array([g.reason for g in got], pa.string()), pa.array([g.units_total for g in got], pa.int32()), pa.array([g.units_ok for g in got], pa.int32())]
            cols.append(pa.array([[{"label": a, "reason": b} for a, b in g.failures] for g in got], pa.list_(pa.struct([("label", pa.string()), ("reason", pa.string())]))))
            cols.append(pa.array([list(g.meta.items()) for g in got], pa.map_(pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], names=[*kept, "text", "status", "reason", "units_total", "units_ok", "failures", "meta"])

    return files.where("skip is null").select(*kept, "content").mapInArrow(run, f"relative_path string, extension string, size long, modified timestamp, {OUTCOME}")


def order_files(files: DataFrame, priority: tuple[str, ...] = (), newest_first: bool = False) -> DataFrame:
    """Files with ``nth`` (from 1): by the first priority folder that holds them, then by time if asked, then by path."""
    rank = F
    rel = F.col("relative_path")
    for i, folder in enumerate(p.strip("/\\").replace("\\", "/") for p in priority if p.strip()):
        rank = rank.when((rel == folder) | rel.startswith(folder + "/"), i)
    rank = rank.otherwise(len(priority)) if priority else F.lit(0)
    age = -F.unix_micros("modified") if newest_first else F.lit(0)
    places = numbered(files.select("relative_path", "modified"), [rank, age, F.lower(rel), rel])
    return files.join(places.select("relative_path", "nth"), "relative_path")


def chunk_records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records from JSON lines, one record per line; blank lines are skipped."""
    schema = "index int, chunk_index int, chunk_count int, file_name string, relative_path string, extension string, size_bytes long, size_text string, summary string, text_length int, text_excerpt string, text string, token_estimate int, extract_status string"
    return spark.read.schema(schema).json(path)
