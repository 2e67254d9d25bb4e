"""Saved records, conditions, sealed payloads, safe paths and names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import text as tx

RECORD = "v int, app string, savedAt string, seq long, playMs long, state string"


def read_record(c: Column, app: str, version: int, migrations: dict[int, object] | None = None) -> Column:
    """(record, too_new) of a JSON record; null if it is another app's, no record, or can't be migrated.

    ``migrations`` maps a version to a function from the record's column to
    that of the next version.
    """
    rec = F.from_json(c, RECORD)
    current, ok = rec, F.lit(True)
    for v in range(version):
        step = (migrations or {}).get(v)
        at = F.coalesce(rec["v"], F.lit(0)) <= v
        if step is None:
            ok = ok & ~at
        else:
            current = F.when(at, step(current)).otherwise(current)
    too_new = F.coalesce(rec["v"], F.lit(0)) > version
    return F.when(rec.isNotNull() & (rec["app"] == app) & (too_new | ok), F.struct(F.when(too_new, rec).otherwise(current).alias("record"), too_new.alias("too_new")))


def condition(cond: str, quests: Column, flags: Column, n_clears: Column, phase: Column, implemented: Column, reportable: Column) -> Column:
    """A dialogue's condition over a state's columns; ``!`` in front negates, unknown ones are false.

    ``quests`` maps ids to their status, ``flags`` names to truth; the last two
    are arrays of quest ids.
    """
    negated = cond.startswith("!")
    kind, _, rest = cond.removeprefix("!").partition(":")
    out = F.lit(False)
    if kind == "quest" and (m := re.fullmatch(r"(\w+):(!?)(\w+)", rest)):
        out = F.coalesce(F.element_at(quests, m[1]), F.lit("offered")) == m[3]
        out = ~out if m[2] else out
    elif kind == "flag" and re.fullmatch(r"\w+", rest):
        out = F.coalesce(F.element_at(flags, rest), F.lit(False))
    elif m := re.fullmatch(r"clears>=(\d+)", cond.removeprefix("!")):
        out = n_clears >= int(m[1])
    elif kind == "phase":
        out = phase == rest
    elif kind in ("impl", "reportable"):
        out = F.array_contains(implemented if kind == "impl" else reportable, rest)
    out = F.coalesce(out, F.lit(False))
    return ~out if negated else out


def seal(plain: Column, key: Column, header: Column) -> Column:
    """AES-GCM with the header as authenticated data; the nonce and the tag are part of the result."""
    return F.aes_encrypt(plain, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), header)


def unseal(sealed: Column, key: Column, header: Column) -> Column:
    """The payload again; null if anything was changed."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), header)


def is_safe_path(c: Column) -> Column:
    """Whether a relative path stays below its root, by segments: neither absolute nor climbing out of it."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    step = lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)
    walked = F.aggregate(parts, F.struct(F.lit(0).alias("depth"), F.lit(True).alias("ok")), lambda a, p: F.struct((a["depth"] + step(p)).alias("depth"), (a["ok"] & (a["depth"] + step(p) >= 0)).alias("ok")))
    return ~c.rlike(r"^([/\\]|[A-Za-z]:)") & walked["ok"]


def unique_names(rows: DataFrame, path_col: str = "path", order: list | None = None) -> DataFrame:
    """rows with ``file_name``: a clean base name, with a number from the second of equal ones on."""
    stem = tx.clean_filename(F.regexp_replace(tx.base_name(F.col(path_col)), r"\.[^.]*$", ""))
    nth = F.row_number().over(W.partitionBy("stem").orderBy(*(order or [path_col])))
    named = rows.withColumn("stem", stem).withColumn("nth", nth)
    return named.withColumn("file_name", F.when(F.col("nth") == 1, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("nth").cast("string")))).drop("stem", "nth")


def first_assets(rows: DataFrame, content_col: str, order: list) -> DataFrame:
    """One row per content, the first in the order, with its SHA-1."""
    nth = F.row_number().over(W.partitionBy("sha1").orderBy(*order))
    return rows.withColumn("sha1", F.sha1(F.col(content_col))).withColumn("nth", nth).where("nth = 1").drop("nth")


def merged_runs(runs: DataFrame, key: list[str], order: str, style: str, text: str) -> DataFrame:
    """Neighbouring runs of equal style as one (key, first, style, text)."""
    w = W.partitionBy(*key).orderBy(order)
    fresh = F.coalesce((~F.lag(style).over(w).eqNullSafe(F.col(style))).cast("int"), F.lit(1))
    island = F.sum("fresh").over(w)
    grouped = runs.withColumn("fresh", fresh).withColumn("island", island).groupBy(*key, "island").agg(F.min(order).alias("first"), F.first(style).alias(style), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias(text))
    return grouped.drop("island")
