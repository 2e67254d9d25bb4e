"""Best-fit packing by bin completion over the histogram of piece lengths.

Only how many pieces there are of each length is needed to choose the
fillings, so the search runs on the driver over at most ``capacity`` counts,
whatever the corpus holds.  Fillings that repeat are one pattern with a
multiplicity; pieces find their place by their rank among those of the same
length.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import bpe
from .common import staged, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length that are ranked by one task, about.
RANKED_TOGETHER = 20_000
#: Nodes of one search for a filling; nodes, and fillings of a bin, of the search over the last pieces; how many those are.
#: Beyond them the best that is known stands: no piece is lost, only the proof that fewer bins won't do.
FILL_NODES, LAST_NODES, MOST_FILLINGS, LAST_PIECES = 3000, 1000, 400, 72


# -- the search -------------------------------------------------------------


def best_filling(room: int, counts: list[int], there: bytearray) -> list[int]:
    """Lengths from the counts that leave the least of ``room``, larger pieces first.

    Depth first over lengths downwards.  Branches that cannot beat the
    incumbent are cut, and an exact filling ends the search; among equal
    sums the one found first stands, which has the larger pieces and so
    dominates those made of smaller ones.  The first leaf is the best-fit
    filling, so a search that runs out of nodes is never worse than that.
    """
    best: list[int] = []
    best_sum, nodes = 0, 0
    chosen: list[int] = []
    used: Counter = Counter()

    def go(left: int, most: int) -> bool:
        nonlocal best, best_sum, nodes
        nodes += 1
        if room - left > best_sum:
            best, best_sum = chosen[:], room - left
            if best_sum == room:
                return True
        if nodes > FILL_NODES:
            return True
        at = there.rfind(1, 1, min(left, most) + 1)
        while at > 0:
            if used[at] < counts[at]:
                #: the largest single choice here bounds what one more piece adds
                used[at] += 1
                chosen.append(at)
                done = go(left - at, at)
                chosen.pop()
                used[at] -= 1
                if done:
                    return True
            at = there.rfind(1, 1, at)
        return False

    go(room, room)
    return best


Patterns = list[tuple[tuple[int, ...], int]]


def complete(counts: list[int], capacity: int, most: int) -> Patterns | None:
    """(filling, how often) for all pieces in fewer than ``most`` bins: the largest piece first, each with its best filling.

    None as soon as more is wasted than fewer bins could waste.
    """
    counts = counts[:]
    there = bytearray(int(c > 0) for c in counts)
    out: Patterns = []
    left = sum(counts)
    allowed = (most - 1) * capacity - sum(x * c for x, c in enumerate(counts))
    while left > LAST_PIECES and allowed >= 0:
        top = there.rfind(1)
        counts[top] -= 1
        there[top] = counts[top] > 0
        filling = [top, *best_filling(capacity - top, counts, there)]
        counts[top] += 1
        need = Counter(filling)
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
            there[x] = counts[x] > 0
        out.append((tuple(filling), times))
        left -= len(filling) * times
        allowed -= times * (capacity - sum(filling))
    if allowed < 0:
        return None
    rest = [x for x in range(len(counts) - 1, 0, -1) for _ in range(counts[x])]
    out += [(b, 1) for b in last_bins(rest, capacity)]
    return out if bins_of(out) < most else None


def bins_of(patterns: Patterns) -> int:
    return sum(n for _, n in patterns)


def best_fit_patterns(counts: list[int], capacity: int) -> Patterns:
    """Best-fit decreasing of all pieces, bins of one content together.

    A bin that takes a piece becomes the fullest that takes the next of its
    length, so it takes as many as it has room for before another does.
    """
    by_room: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]
    there = bytearray(capacity + 1)

    def put(content: tuple, room: int, n: int) -> None:
        by_room[room][content] = by_room[room].get(content, 0) + n
        there[room] = 1

    for x in range(capacity, 0, -1):
        left = counts[x] if x < len(counts) else 0
        while left:
            room = there.find(1, x)
            if room < 0:  # as many new bins as these pieces fill, and one for the rest
                room, content, n = capacity, (), -(-left // (capacity // x))
            else:
                content, n = by_room[room].popitem()
                there[room] = bool(by_room[room])
            per = room // x
            full = min(n, left // per)
            if full:
                put((*content, (x, per)), room - per * x, full)
                left -= full * per
            if full < n and left:
                put((*content, (x, left)), room - left * x, 1)
                full, left = full + 1, 0
            if content and full < n:
                put(content, room, n - full)
    return [(tuple(x for x, k in content for _ in range(k)), n) for row in by_room for content, n in row.items()]


def repacked(patterns: Patterns, capacity: int) -> Patterns:
    """The patterns with the emptiest bins, of LAST_PIECES pieces at most, packed anew if that takes fewer."""
    rest, taken, pieces = [], [], 0
    for filling, n in sorted(patterns, key=lambda p: sum(p[0])):
        some = min(n, (LAST_PIECES - pieces) // max(1, len(filling))) if sum(filling) < capacity else 0
        taken += [filling] * some
        pieces += some * len(filling)
        rest += [(filling, n - some)] if n > some else []
    anew = last_bins([x for f in taken for x in f], capacity)
    return rest + [(b, 1) for b in anew] if len(anew) < len(taken) else patterns


def few_bins(counts: list[int], capacity: int) -> Patterns:
    """Fillings of few bins for a histogram of lengths.

    Bin completion makes them: around the largest piece left, with a bound on
    what may be wasted.  Best-fit decreasing of everything is the incumbent,
    and stands only where completion needs more bins.  Above the bound by
    volume, the emptiest bins are searched once more by branch and bound.
    """
    incumbent = best_fit_patterns(counts, capacity)
    best = complete(counts, capacity, bins_of(incumbent) + 1) or incumbent
    if bins_of(best) > -(-sum(x * c for x, c in enumerate(counts)) // capacity):
        best = repacked(best, capacity)
    return best


def best_fit(pieces: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing: each piece into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[int] = []
    for x in sorted(pieces, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            i = min(fits, key=lambda i: room[i])
            bins[i].append(x)
            room[i] -= x
        else:
            bins.append([x])
            room.append(capacity - x)
    return [tuple(b) for b in bins]


def undominated(room: int, pieces: list[int]) -> list[tuple[int, ...]]:
    """Fillings of ``room`` to which no piece can be added, without dominated ones.

    A filling is dominated if one piece outside it is at least as long as
    one or two of its pieces together and fits in their place, longer than
    they are.  The fullest come first.
    """
    kinds = sorted(Counter(pieces).items(), reverse=True)
    found: set[tuple[int, ...]] = set()

    def go(i: int, left: int, chosen: tuple[int, ...]) -> None:
        if len(found) > MOST_FILLINGS:
            return
        if i == len(kinds):
            found.add(chosen)
            return
        x, n = kinds[i]
        for k in range(min(n, left // x), -1, -1):
            go(i + 1, left - k * x, chosen + (x,) * k)

    go(0, room, ())
    count = Counter(pieces)
    out = []
    for f in sorted(found, key=lambda f: (-sum(f), len(f))):
        rest, waste = count - Counter(f), room - sum(f)
        if any(x <= waste for x in rest):
            continue
        groups = [*f, *(a + b for i, a in enumerate(f) for b in f[i + 1 :])]
        if any(g < x <= g + waste or (x == g and g not in f) for g in groups for x in rest):
            continue
        out.append(f)
    return out or [()]


def last_bins(pieces: list[int], capacity: int) -> list[tuple[int, ...]]:
    """Few bins for few pieces: branch and bound over undominated fillings.

    Best-fit decreasing is the first incumbent.  A branch ends when its waste
    exceeds what a better packing may waste at most.
    """
    best = best_fit(pieces, capacity)
    nodes = 0

    def go(left: list[int], bins: list[tuple[int, ...]], waste: int) -> None:
        nonlocal best, nodes
        nodes += 1
        if not left:
            if len(bins) < len(best):
                best = bins
            return
        allowed = (len(best) - 1) * capacity - sum(pieces)
        if nodes > LAST_NODES or waste > allowed or len(bins) + -(-sum(left) // capacity) >= len(best):
            return
        top, rest = left[0], left[1:]
        for f in undominated(capacity - top, rest):
            more = list((Counter(rest) - Counter(f)).elements())
            go(sorted(more, reverse=True), [*bins, (top, *f)], waste + capacity - top - sum(f))
            if -(-sum(pieces) // capacity) == len(best):
                return

    go(sorted(pieces, reverse=True), [], 0)
    return best


@dataclass
class Plan:
    """Where the pieces of each rank go; its size depends on the capacity alone."""

    n_bins: int
    rows: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Rows (length, first rank, end rank, first bin, pieces per bin, offset).

    The piece of rank r among those of its length, with first <= r < end, goes
    to bin ``first bin + (r - first) // per`` at ``offset + length * ((r -
    first) % per)``.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    full = counts[capacity]
    counts[capacity] = 0
    patterns = [((capacity,), full)] if full else []
    patterns += few_bins(counts, capacity)
    plan, rank = Plan(0), Counter()
    for filling, times in patterns:
        offset = 0
        for length, per in sorted(Counter(filling).items(), reverse=True):
            plan.rows.append((length, rank[length], rank[length] + per * times, plan.n_bins, per, offset))
            rank[length] += per * times
            offset += per * length
        plan.n_bins += times
    return plan


# -- over the corpus ---------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def tokens(path: str):
    """A function from text to the library's ids, for one worker.

    The ids come from the rank encoder, which has the same vocabulary and
    pattern; texts that it refuses go through the merge loop of :mod:`bpe`.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte_of = {c: b for b, c in bpe.byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, s)): i for s, i in spec["model"]["vocab"].items() if s not in special}
    encoding = tiktoken.Encoding("own", pat_str=bpe.PRETOKEN, mergeable_ranks=ranks, special_tokens=special)
    slow: list[bpe.Encoder] = []

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:  # a run of blanks too long for the pattern's stack
            if not slow:
                slow.append(bpe.Encoder(bpe.Bpe(path), list))
            return [i for part in slow[0].parts(text) for i in part]

    return encode


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every row; no shuffle."""

    def run(batches):
        encode = tokens(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for i, t in zip(batch.column(0), batch.column(1)):
                ids = np.array([*encode(t.as_py() or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for to, x in zip(rows, (i.as_py(), k, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], batch.column(0).type), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; every sequence is gapless from 0.

    Needs doc_id, piece, length and ids_crc32, lengths from 1 to ``capacity``;
    they are read twice, so hand in something staged.  Repeated rows are
    pieces of their own.  An empty table stays empty.

    Ranks within a length are made of the rank within a hashed part of it and
    the sizes of the parts before, so a length that most pieces share is
    ranked by many tasks.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_bins(histogram, capacity)
    salts = max(8, -(-max(histogram.values(), default=1) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(sizes, ["length", "salt"]).withColumn("r", F.col("nth") + F.col("before"))
    places = spark.createDataFrame(pa.table([pa.array([r[i] for r in plan.rows], pa.int64()) for i in range(6)], names=["p_length", "p_first", "p_end", "p_bin", "p_per", "p_offset"]))
    fits = (F.col("length") == F.col("p_length")) & (F.col("r") >= F.col("p_first")) & (F.col("r") < F.col("p_end"))
    nth = F.col("r") - F.col("p_first")
    return (
        ranked.join(F.broadcast(places), fits)
        .withColumn("sequence_id", (F.col("p_bin") + F.floor(nth / F.col("p_per"))).cast("long"))
        .withColumn("offset", (F.col("p_offset") + F.col("length") * (nth % F.col("p_per"))).cast("long"))
        .select(*pieces.columns, "sequence_id", "offset")
    )


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pack(staged(pieces))
