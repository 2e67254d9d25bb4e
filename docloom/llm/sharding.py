"""Shards of near-equal bytes by sampled splitters."""

from __future__ import annotations

import bisect
import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import find_range, pick, staged, table, uniform

SHARDS = 8
#: Ranges between splitters, and rows that the splitters are chosen from, about.
RANGES, SAMPLES = 512, 16_384
#: A text that is so many times a range's share has a range of its own; there are at most RANGES / CROWDED of them.
CROWDED = 4
#: Rows that one task numbers, about.
NUMBERED_TOGETHER = 1_000


def lightest(sizes: list[tuple[tuple[int, int], int]], shards: int) -> dict[tuple[int, int], int]:
    """Each unit to the shard that is lightest so far, heaviest units first."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for unit, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[unit] = s
        heapq.heappush(heap, (load + n, s))
    return out


def splitters(rows: DataFrame, total: int, ranges: int, samples: int) -> list[int]:
    """Quantile boundaries of the key, each range holding about as many bytes.

    A row is drawn with a chance in proportion to its size; one heavier than
    a sample's share is drawn for sure, with its weight.
    """
    share = F.col("size") * (samples / total)
    drawn = rows.where(uniform("doc_id", "text_crc32", F.lit("sample")) < share)
    at = [i / ranges for i in range(1, ranges)]
    got = drawn.agg(F.percentile("key", at, F.greatest(F.lit(1), F.round(share)).cast("int")).alias("q")).first()["q"]
    return sorted({math.ceil(x) for x in got or []})


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    The law is ``bytes``: shards have near-equal sums of size (UTF-8 bytes
    plus 1).  Records are keyed by a hash of the text, range-partitioned at
    the sampled splitters, and whole ranges go to the lightest shard, so equal
    texts share a shard.  A text that fills several ranges gets one of its
    own, and if its copies outweigh a shard they are subdivided by id; the
    texts around it stay together.  Slots number a shard's rows without gaps; they are
    made of the sizes of the parts before and the rank within a part, where an
    overfull range is divided further, so no task numbers a whole shard.

    Null text: no bytes, size 1, crc of nothing (0).  Repeated rows take slots
    of their own.  An empty table stays empty.  Built-in functions only; the
    driver sees per-range sums, whose number is bounded by ``ranges``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 12).alias("key"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    bounds = splitters(rows, total, ranges, samples)
    ranged = rows.withColumn("range", find_range(bounds, F.col("key")))
    n_ranges = len(bounds) + 1

    room, much = total / shards, CROWDED * total / ranges
    crowded = [r["range"] for r in ranged.groupBy("range").agg(F.sum("size").alias("b")).where(F.col("b") > much).collect()]
    heavy = {}
    if crowded:
        by_key = ranged.where(F.col("range").isin(crowded)).groupBy("key").agg(F.sum("size").alias("b"))
        heavy = {r["key"]: r["b"] for r in by_key.where(F.col("b") > much).collect()}
        bounds = sorted({*bounds, *heavy, *(k + 1 for k in heavy)})
        ranged, n_ranges = rows.withColumn("range", find_range(bounds, F.col("key"))), len(bounds) + 1
    #: a heavy key has a range of its own, the one that begins with it
    pieces = [1] * n_ranges
    for k, b in heavy.items():
        pieces[bisect.bisect_right(bounds, k)] = math.ceil(8 * b / room) if b > 0.9 * room else 1
    parted = ranged.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), pick(pieces, F.col("range"))).cast("int"))
    sums = parted.groupBy("range", "part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    to = lightest([((r["range"], r["part"]), r["b"]) for r in sums], shards)
    rows_in = {(r["range"], r["part"]): r["n"] for r in sums}

    def per_unit(value):
        return F.element_at(F.element_at(F.array(*[F.array(*[F.lit(value(r, p)) for p in range(pieces[r])]) for r in range(n_ranges)]), F.col("range") + 1), F.col("part") + 1)

    cuts = per_unit(lambda r, p: max(1, -(-rows_in.get((r, p), 0) // NUMBERED_TOGETHER)))
    placed = parted.withColumn("shard", per_unit(lambda r, p: to.get((r, p), 0))).withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit("sub")), cuts).cast("int"))
    unit = ["shard", "range", "part", "sub"]
    before = W.partitionBy("shard").orderBy("range", "part", "sub").rowsBetween(W.unboundedPreceding, -1)
    offsets = placed.groupBy(*unit).agg(F.count("*").alias("n")).select(*unit, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(W.partitionBy(*unit).orderBy("key", "doc_id", "size", "text_crc32")) - 1
    return placed.withColumn("nth", nth).join(offsets, unit).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
