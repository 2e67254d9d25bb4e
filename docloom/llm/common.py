"""What the operators of this package share: text batches and lookups; staging and components come from the library."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components  # noqa: F401
from ..plans.staging import release, staged  # noqa: F401

#: Texts are handled in slices of about so many bytes, whatever the batch holds.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame, known) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but the known ones under names that clash with none, and what gives them their names back."""
    names = docs.columns
    safe = [c if c in known else f"aside_{i}" for i, c in enumerate(names)]
    return docs.toDF(*safe), lambda out: out.select(*safe).toDF(*names)


# -- batches ----------------------------------------------------------------


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a string array; null is empty.

    A slice holds at least one row and otherwise at most ``most`` bytes.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        end = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, raw[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def crc_mod(col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """``work`` on the table of each cell, cells streamed in key order within a partition."""
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c) for c in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in cols:
                code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                now = tuple(c[a].as_py() for c in cols)
                if now != last:
                    if held:
                        yield from work(pa.Table.from_batches(held))
                    held, last = [], now
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return map_arrow(ordered, run, schema)


# -- lookups in bounded lists -------------------------------------------------


def find_range(bounds: list, value: Column) -> Column:
    """How many of the ascending bounds are <= value, by a search in two levels.

    The bounds are literals, so only lists of a bounded length belong here.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    coarse = F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]) if len(bounds) >= step else F.array()
    fine = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]] or [F.lit(bounds[-1])]) for i in range(0, len(bounds) + 1, step)])
    at = F.size(F.filter(coarse, lambda b: b <= value))
    if len(bounds) % step == 0:  # the last fine list is empty and stands for "beyond all"
        rest = F.when(at * step >= len(bounds), F.lit(0)).otherwise(F.size(F.filter(F.element_at(fine, at + 1), lambda b: b <= value)))
    else:
        rest = F.size(F.filter(F.element_at(fine, at + 1), lambda b: b <= value))
    return at * step + rest


def pick(values: list, index: Column) -> Column:
    """values[index] of a bounded list of literals."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def uniform(*cols: Column | str) -> Column:
    """A number in [0, 1) that the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))
