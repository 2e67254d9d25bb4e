"""Bytes as text of 64 letters, six bits each, and used characters as ranges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import let

#: The letters for 0 to 63.
LETTERS = "あいうえおかきくけこしすせそたちつてとなにのはひふへまみむめもやゆよらりるれをんがぎぐげござじずぜぞだづでどばびぶべぼぱぴぷぺぽ"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LINE_LETTERS, MAX_LINES = 40, 100_000
#: Code points there are; characters that are counted at once, about.
POINTS, SLICE = 0x110000, 1_000_000


def to_letters(raw: Column) -> Column:
    """The bytes' base64 letters without padding, replaced one by one."""
    return F.translate(F.regexp_replace(F.base64(raw), "[\r\n=]", ""), BASE64, LETTERS)


def from_letters(c: Column) -> Column:
    """The bytes again; null if a letter is unknown, the length impossible or a spare bit set."""
    #: a class of 64 kana is slow to match; letters of base64 are known by what they become
    known = ~c.rlike("[A-Za-z0-9+/]") & (F.length(c) % 4 != 1)

    def read(plain: Column) -> Column:
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), "=")
        return let(F.try_to_binary(padded, F.lit("base64")), lambda raw: F.when(plain.rlike(r"^[A-Za-z0-9+/]*\z") & (F.regexp_replace(F.base64(raw), "[\r\n=]", "") == plain), raw))

    return F.when(known, let(F.translate(c, LETTERS, BASE64), read))


def card_lines(cards: DataFrame, width: int = LINE_LETTERS) -> DataFrame:
    """(slot, line, data) of rows (slot, data): the letters cut into lines, counted from 0."""
    return cards.where(F.length("data") > 0).select("slot", F.posexplode(F.regexp_extract_all("data", F.lit(f"(?s).{{1,{width}}}"), F.lit(0))).alias("line", "data"))


def read_card(lines: DataFrame) -> DataFrame:
    """(slot, data, ok) of lines in any order; a missing or repeated line makes the slot bad."""
    clean = lines.select("slot", "line", F.regexp_replace("data", r"[\s　]+", "").alias("data"))
    whole = clean.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("line", "data"))).alias("lines"))
    in_place = lambda x, i: x["line"].eqNullSafe(i) & F.coalesce(x["data"] != "", F.lit(True))
    fine = F.forall(F.transform("lines", in_place), lambda ok: ok) & (F.size("lines") <= MAX_LINES)
    return whole.select("slot", F.array_join("lines.data", "").alias("data"), fine.alias("ok"))


def used_characters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cp, n) of the characters that occur; counted per task first, so that little is shuffled."""

    def run(batches):
        n = np.zeros(POINTS, np.int64)
        held, size = [], 0

        def count() -> None:
            found = np.bincount(np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32))
            n[: len(found)] += found

        for batch in batches:
            for text in batch.column(0):
                held.append(text.as_py())
                size += len(held[-1])
                if size >= SLICE:
                    count()
                    held, size = [], 0
        count()
        points = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(points, pa.int32()), pa.array(n[points])], names=["cp", "n"])

    return docs.select(text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, "cp int, n long").groupBy("cp").agg(F.sum("n").alias("n"))


def code_ranges(points: DataFrame) -> DataFrame:
    """(first, last) of runs of code points (cp); at most as many rows as there are characters."""
    run = F.col("cp") - F.row_number().over(W.orderBy("cp"))
    return points.select("cp").distinct().withColumn("run", run).groupBy("run").agg(F.min("cp").alias("first"), F.max("cp").alias("last")).drop("run")
