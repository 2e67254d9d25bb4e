"""Order-dependent packing of sized items into parts, group by group.

A group is folded in order by one task, in a stream: it holds the sizes of the
parts, never the items.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART_CHARS, PART_TOKENS, MAX_PARTS, MARKDOWN_CHARS = 30_000, 21_000, 19, 120_000


class Sequential:
    """Into the last part; a new one when it would overflow; beyond the last part an item is left over, but a smaller one may still fit."""

    def __init__(self, capacity: int, parts: int):
        self.capacity, self.parts, self.used, self.now = capacity, parts, 0, 1

    def place(self, size: int) -> int | None:
        if self.used and self.used + size > self.capacity:
            if self.now == self.parts:
                return None
            self.now, self.used = self.now + 1, 0
        self.used += size
        return self.now


class BestFit:
    """Into the part with the least room left that takes it, the first of equals; an empty part takes anything."""

    def __init__(self, capacity: int, parts: int):
        self.capacity, self.parts, self.used = capacity, parts, [0]

    def place(self, size: int) -> int | None:
        fits = [(self.capacity - u, i) for i, u in enumerate(self.used) if not u or u + size <= self.capacity]
        if fits:
            at = min(fits)[1]
        elif len(self.used) < self.parts:
            self.used.append(0)
            at = len(self.used) - 1
        else:
            return None
        self.used[at] += size
        return at + 1


class Rollover:
    """A new part whenever the running size would exceed the limit; every part starts with a header's size."""

    def __init__(self, capacity: int, header: int):
        self.capacity, self.header, self.now, self.used, self.empty = capacity, header, 1, header, True

    def place(self, size: int) -> int:
        if not self.empty and self.used + size > self.capacity:
            self.now, self.used = self.now + 1, self.header
        self.used += size + 1
        self.empty = False
        return self.now


RULES = {"sequential": Sequential, "bestfit": BestFit, "rollover": Rollover}


def pack(items: DataFrame, rule: str = "sequential", capacity: int = PART_CHARS, limit: int = MAX_PARTS, group_col: str = "grp", order_col: str = "ord", size_col: str = "size") -> DataFrame:
    """The items with ``part`` (from 1); null for those left over.

    ``limit`` is the number of parts, or the header's size for ``rollover``.
    """
    make = RULES[rule]
    names = items.columns
    at_group, at_size = names.index(group_col), names.index(size_col)
    ordered = items.repartition(group_col).sortWithinPartitions(group_col, order_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, last = None, object()
        for batch in batches:
            out = []
            for group, size in zip(batch.column(at_group).to_pylist(), batch.column(at_size).to_pylist()):
                if group != last:
                    bins, last = make(capacity, limit), group
                out.append(bins.place(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*names, "part"])

    return ordered.mapInArrow(run, T.StructType([*items.schema.fields, T.StructField("part", T.IntegerType())]))


def part_totals(packed: DataFrame, group_col: str = "grp", size_col: str = "size") -> DataFrame:
    return packed.groupBy(group_col, "part").agg(F.count("*").alias("n_items"), F.sum(size_col).alias("chars"))
