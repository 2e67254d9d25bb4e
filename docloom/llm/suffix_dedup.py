"""Removal of repeated byte strings by a sparse suffix array.

Every string of ``LENGTH`` bytes holds an anchor: the least of its ``GRAM``-byte
hashes.  Equal strings have the anchor at the same place, so only anchors
whose gram occurs again have to be sorted.  Their contexts, ``REACH`` bytes to
either side of the gram, are sorted in both directions by deep-shallow
sorting: multikey sorting by words to a shallow depth, then blind tries for
what still is equal there.  Common prefixes of neighbours in the two orders
tell for each anchor how far a repeated string of full length extends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, release, staged, table, text_slices
from .shingles import _LETTER, _SPACE, _power, mixed, word_hashes

LENGTH, GRAM = 400, 100
REACH = LENGTH - GRAM
#: Bytes that multikey sorting looks at before the tries take over.
SHALLOW = 32
#: Window starts that are worked on at once, and context bytes that are sorted at once, about.
SEGMENT, SORTED_TOGETHER = 1 << 20, 12 << 20
#: Distinct contexts of one gram that are sorted as one group; larger groups are divided by half a context.
MOST_CONTEXTS = 10_000
#: Words of a passage that may not stand in two places, and of the grams that anchor a run of words.
PASSAGE, WORD_GRAM = 51, 8
_SLICE = 2 << 20
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# -- anchors ------------------------------------------------------------------


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash of the gram there) of the anchors of texts laid end to end, ascending.

    The anchor of a window is its least hash, the leftmost of equal ones, so
    it depends on nothing but the window's bytes.  Grams that repeat a part of
    at most half their length come after all others: a stretch of such text is
    anchored at its borders, and inside only where a window holds nothing else.
    """
    n = len(raw)
    inside = np.zeros(n + 1, np.int32)  # whether a window that starts here ends in the same text
    full = np.flatnonzero(np.diff(offsets) >= LENGTH)
    inside[offsets[full]] += 1
    np.add.at(inside, offsets[full + 1] - LENGTH + 1, -1)
    inside = np.cumsum(inside[:n]) > 0
    positions, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    low = np.uint64((1 << 22) - 1)
    for start in range(0, n, SEGMENT):
        part = raw[start : start + SEGMENT + LENGTH - 1]
        windows = len(part) - LENGTH + 1
        here = inside[start : start + max(0, windows)]
        if windows <= 0 or not here.any():
            continue
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * up, out=total[1:])
        grams = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
        top = np.uint64(1 << 63)
        ranked = np.where(periodic(part), grams | top, grams & ~top)
        least = (ranked & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = REACH + 1
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (least[:windows] & low).astype(np.int64)[here]
        at = np.unique(at[np.append(True, at[1:] != at[:-1])])
        positions.append(at + start)
        hashes.append(grams[at])
    position, value = np.concatenate(positions), np.concatenate(hashes)
    first = np.unique(position, return_index=True)[1]
    return position[first], value[first]


def periodic(raw: np.ndarray) -> np.ndarray:
    """Whether the gram at each place has a period of at most half its length."""
    out = np.zeros(len(raw) - GRAM + 1, bool)
    ones = np.uint64(0x0101010101010101)
    for p in range(1, GRAM // 2 + 1):
        same = raw[p:] == raw[:-p]
        #: a long run holds several whole words of equal bytes; most distances have few
        words = same[: len(same) // 8 * 8].view(np.uint64) == ones
        if len(words) < 4:
            continue
        at = np.flatnonzero(words[:-3] & words[1:-2] & words[2:-1] & words[3:])
        if not len(at):
            continue
        need, edges = GRAM - p, np.flatnonzero(np.diff(at) > GRAM // 4) + 1
        for i, j in zip(np.append(0, edges), np.append(edges, len(at))):
            lo, hi = max(0, 8 * at[i] - GRAM), 8 * at[j - 1] + 32 + GRAM
            total = np.concatenate([[0], np.cumsum(same[lo:hi], dtype=np.int32)])
            full = total[need:] - total[: max(0, len(total) - need)] == need
            part = out[lo : lo + len(full)]
            part |= full[: len(part)]
    return out


def thinned(position: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(which anchors of a text to keep, spans that repeat themselves).

    Equal grams that overlap at one distance make the text periodic from the
    first to the last; if that stretch is a period longer than LENGTH, each of
    its strings occurs again a period on, so all of it goes.  A string that crosses the end of the stretch may have its anchor up to
    REACH bytes before that, so of the anchors all within LENGTH bytes of
    either end are kept, and at least three.  With a period of at most half a
    gram three will do: a string that crosses an end holds a gram that does,
    and such grams come before those inside.
    """
    keep = np.ones(len(position), bool)
    spans: list[tuple[int, int]] = []
    if len(position) < 3:
        return keep, spans
    gap = np.diff(position)
    same = (value[1:] == value[:-1]) & (gap <= GRAM)
    if not same.any():
        return keep, spans
    joined = same[1:] & same[:-1] & (gap[1:] == gap[:-1])
    i = 0
    hits = np.flatnonzero(same)
    while i < len(hits):
        a = b = hits[i]
        while b < len(joined) and joined[b]:
            b += 1
        lo, hi = int(position[a]), int(position[b + 1]) + GRAM
        if hi - lo >= LENGTH + gap[a]:
            spans.append((lo, hi))
            ends = LENGTH if gap[a] > GRAM // 2 else 0
            first = max(a + 3, int(np.searchsorted(position, lo + ends, side="right")))
            last = min(b - 1, int(np.searchsorted(position, hi - GRAM - ends)))
            keep[first:last] = False
        i = int(np.searchsorted(hits, b + 1))
    return keep, spans


def least_of_windows(values: np.ndarray, span: int) -> np.ndarray:
    """The place of the least of each ``span`` values in a row, the leftmost of equal ones (all but their lowest bits)."""
    n = len(values) - span + 1
    out = [np.zeros(0, np.int64)]
    low = np.uint64((1 << 22) - 1)
    for start in range(0, max(0, n), SEGMENT):
        part = values[start : start + SEGMENT + span - 1]
        least = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        out.append((least[:SEGMENT] & low).astype(np.int64) + start)
    return np.concatenate(out)


def _anchor_rows(docs: DataFrame, words: int | None) -> DataFrame:
    """(doc_id, tid, grams, positions, spans, keys) per row (doc_id, tid, text); keys are the grams of words that anchor its runs of ``words`` words."""

    def run(batches):
        for batch in batches:
            grams, positions, lows, highs, keys = [], [], [], [], []
            for a, b, raw, off in text_slices(batch.column("text"), _SLICE):
                position, value = anchors(raw, off)
                cut = np.searchsorted(position, off)
                key, before = word_anchors(*word_hashes(raw, off), words) if words else (np.zeros(0, np.uint64), np.zeros(len(off), np.int64))
                for i in range(b - a):
                    p, v = position[cut[i] : cut[i + 1]] - off[i], value[cut[i] : cut[i + 1]]
                    keep, spans = thinned(p, v)
                    grams.append(v[keep].view(np.int64))
                    positions.append(p[keep].astype(np.int32))
                    lows.append([s[0] for s in spans])
                    highs.append([s[1] for s in spans])
                    keys.append(key[before[i] : before[i + 1]].view(np.int64))
            lists = [pa.array(grams, pa.list_(pa.int64())), pa.array(positions, pa.list_(pa.int32())), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), *lists], names=["doc_id", "tid", "grams", "positions", "lows", "highs", "keys"])

    return map_arrow(docs, run, "doc_id long, tid long, grams array<long>, positions array<int>, lows array<int>, highs array<int>, keys array<long>")


# -- deep-shallow sorting -------------------------------------------------------


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n - 1  # x[:lo] equal, x[:hi + 1] not
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def blind_order(members: list[int], strings: list[bytes]) -> list[int]:
    """The members in the order of their strings, by a blind trie.

    An inner node knows only its depth and the byte behind each branch.  A
    string walks down blindly, is compared once with the leaf it reaches, and
    branches off where the two differ.  A string's end sorts before any byte.
    """
    root: list | None = None
    for i in members:
        x = strings[i]
        if root is None:
            root = [None, [i]]
            continue
        node, path = root, []
        while node[0] is not None:
            path.append(node)
            depth = node[0]
            kids = node[1]
            node = kids.get(x[depth] if depth < len(x) else -1) or next(iter(kids.values()))
        y = strings[node[1][0]]
        depth = common_prefix(x, y)
        if depth == len(x) == len(y):
            node[1].append(i)
            continue
        mine = x[depth] if depth < len(x) else -1
        parent = None
        for at in path:
            if at[0] >= depth:
                break
            parent = at
        else:
            at = node
        if at[0] == depth:
            at[1][mine] = [None, [i]]
            continue
        branch = [depth, {mine: [None, [i]], (y[depth] if depth < len(y) else -1): at}]
        if parent is None:
            root = branch
        else:
            parent[1][x[parent[0]] if parent[0] < len(x) else -1] = branch
    out: list[int] = []
    stack = [root] if root is not None else []
    while stack:
        depth, rest = stack.pop()
        if depth is None:
            out += rest
        else:
            stack += [rest[k] for k in sorted(rest, reverse=True)]
    return out


def deep_shallow(heads: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, prefix in common with the string before) of strings within equal heads.

    Strings of at most REACH bytes.  -1 stands where another head begins.
    """
    n = len(strings)
    flat = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, -1)
    order = np.lexsort([*flat.T[::-1], heads])
    words, head = flat[order], heads[order]
    fresh = np.append(True, (head[1:] != head[:-1]) | (words[1:] != words[:-1]).any(1)) if n else np.zeros(0, bool)
    starts = np.append(np.flatnonzero(fresh), n)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a > 1:
            order[a:b] = blind_order(order[a:b].tolist(), strings)
    full = np.frombuffer(b"".join(s.ljust(REACH, b"\0") for s in strings), np.uint8).reshape(n, REACH)
    length = np.array([len(s) for s in strings], np.int64)
    lcp = np.full(n, -1, np.int64)
    for a in range(1, n, 1 << 15):
        now, before = order[a : a + (1 << 15)], order[a - 1 : a - 1 + (1 << 15)][: len(order[a : a + (1 << 15)])]
        differs = full[now] != full[before]
        first = np.where(differs.any(1), differs.argmax(1), REACH)
        lcp[a : a + len(now)] = np.where(heads[now] == heads[before], np.minimum(first, np.minimum(length[now], length[before])), -1)
    return order, lcp


def shared_offsets(heads: np.ndarray, left: list[bytes], right: list[bytes], lo: int = 0, hi: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """For each context, the least and greatest o from lo to hi such that another of its head has the same string of LENGTH bytes from o before the gram; -1 if none has.

    ``left`` is reversed, ``right`` begins behind the gram.  Two contexts share
    the string at o if they share o bytes to the left and REACH - o to the
    right: if they stand in the same run of neighbours in both orders.
    """
    n = len(heads)
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return least, most
    order_l, lcp_l = deep_shallow(heads, left)
    order_r, lcp_r = deep_shallow(heads, right)
    run_l, run_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(lo, hi + 1):
        run_l[order_l] = np.cumsum(lcp_l < o)
        run_r[order_r] = np.cumsum(lcp_r < REACH - o)
        key = run_l * (n + 1) + run_r
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        at = np.searchsorted(twice, key)
        found = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == key)
        least[found] = np.where(least[found] < 0, o, least[found])
        most[found] = o
    return least, most


def own_offsets(count: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for contexts that occur more than once as a whole: every o that they have room for."""
    a, b = np.array([len(x) for x in left], np.int64), np.array([len(x) for x in right], np.int64)
    whole = (count > 1) & (a + b >= REACH)
    return np.where(whole, REACH - b, -1), np.where(whole, a, -1)


# -- over the corpus ------------------------------------------------------------


def _contexts(texts: DataFrame) -> DataFrame:
    """(rep, tid, pos, gram, ctx, left, right) per anchor of rows (rep, tid, text, marks)."""

    def run(batches):
        import xxhash

        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode("utf-8")
                rows: list[list] = [[], [], [], [], []]
                for m in batch.column("marks")[i].as_py():
                    p = m["pos"]
                    left, right = raw[max(0, p - REACH) : p][::-1], raw[p + GRAM : p + LENGTH]
                    ctx = xxhash.xxh3_64_intdigest(len(left).to_bytes(2, "little") + left + right) - (1 << 63)
                    for to, v in zip(rows, (p, m["gram"], ctx, left, right)):
                        to.append(v)
                n = len(rows[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in ("rep", "tid")] + [pa.array(v, t) for v, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["rep", "tid", "pos", "gram", "ctx", "left", "right"],
                )

    return map_arrow(texts, run, "rep long, tid long, pos long, gram long, ctx long, left binary, right binary")


def _offsets(contexts: DataFrame) -> DataFrame:
    """(gram, ctx, least, most) of the contexts (gram, ctx, left, right) that hold a repeated string.

    Contexts of a gram are one group.  A group of more than MOST_CONTEXTS is
    divided twice: strings that begin in the farther half of the left side
    need the nearer half of it in common, all others half of the right side.
    """
    half = REACH // 2
    distinct = contexts.groupBy("gram", "ctx").agg(F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("n"))
    crowded = contexts.select("gram", "ctx").distinct().groupBy("gram").agg(F.count("*").alias("held")).where(F.col("held") > MOST_CONTEXTS)
    crowded = staged(crowded.select("gram", F.lit(True).alias("crowded")))
    one = F.array(F.struct(F.col("gram").alias("head"), F.lit(0).alias("lo"), F.lit(REACH).alias("hi")))
    if crowded.isEmpty():
        rows = distinct.withColumn("part", F.explode(one))
    else:
        side = lambda c, lo, hi: F.struct(F.xxhash64("gram", F.lit(c), F.substring(c, 1, half)).alias("head"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
        two = F.array(side("left", half, REACH), side("right", 0, half - 1))
        rows = distinct.join(crowded, "gram", "left").withColumn("part", F.explode(F.when(F.col("crowded"), two).otherwise(one)))
    rows = rows.select("gram", "ctx", "left", "right", "n", "part.head", "part.lo", "part.hi")
    ordered = rows.repartition("head").sortWithinPartitions("head")

    def solve(held):
        t = pa.Table.from_batches(held)
        head, lo, hi = t["head"].to_numpy(), t["lo"].to_numpy(), t["hi"].to_numpy()
        left, right = t["left"].to_pylist(), t["right"].to_pylist()
        least, most = own_offsets(t["n"].to_numpy(), left, right)
        for a, b in {(int(x), int(y)) for x, y in zip(lo, hi)}:
            at = np.flatnonzero(lo == a)
            #: a context alone with its head shares nothing
            _, back, times = np.unique(head[at], return_inverse=True, return_counts=True)
            at = at[times[back] > 1]
            x, y = shared_offsets(head[at].view(np.uint64), [left[i] for i in at], [right[i] for i in at], a, b)
            least[at] = np.where((least[at] < 0) | ((x >= 0) & (x < least[at])), x, least[at])
            most[at] = np.maximum(most[at], y)
        hit = np.flatnonzero(least >= 0)
        return pa.RecordBatch.from_arrays([pa.array(t["gram"].to_numpy()[hit]), pa.array(t["ctx"].to_numpy()[hit]), pa.array(least[hit]), pa.array(most[hit])], names=["gram", "ctx", "least", "most"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                head = part.column("head").to_numpy()
                if size > SORTED_TOGETHER:  # a chunk ends only where another head begins
                    fresh = np.flatnonzero(head != last)
                    cut = int(fresh[0]) if len(fresh) else len(head)
                    if cut:
                        held.append(part.slice(0, cut))
                    if cut < len(head):
                        yield solve(held)
                        held, size = [], 0
                    part, head = part.slice(cut), head[cut:]
                if part.num_rows:
                    held.append(part)
                    size += part.num_rows * 2 * REACH
                    last = head[-1]
        if held:
            yield solve(held)

    found = map_arrow(ordered, run, "gram long, ctx long, least long, most long")
    return found.groupBy("gram", "ctx").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


# -- runs of words --------------------------------------------------------------


def _hashes_of(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of the ``length`` words that start at each word."""
    up, down = _power(len(words))
    total = np.append(np.uint64(0), np.cumsum(words * up, dtype=np.uint64))
    return mixed((total[length:] - total[:-length]) * down[: len(words) - length + 1])


def word_anchors(words: np.ndarray, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the gram of words that anchors a run of ``length`` words, one for each place; how many stand before each text) for texts end to end.

    A run's anchor is its least gram, the leftmost of equal ones, so equal
    runs have equal anchors, and a run that occurs twice has two.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(before), np.int64)
    inside = np.zeros(len(words) + 1, np.int32)
    full = np.flatnonzero(np.diff(before) >= length)
    inside[before[full]] += 1
    np.add.at(inside, before[full + 1] - length + 1, -1)
    gram = min(WORD_GRAM, length)
    hashes = _hashes_of(words, gram)
    at = least_of_windows(hashes, length - gram + 1)[np.cumsum(inside)[:n] > 0]
    at = np.unique(at[np.append(True, at[1:] != at[:-1])]) if len(at) else at
    return hashes[at], np.searchsorted(at, before)


def _sequence(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, grams, place of the anchor of each run of ``length`` words) of a text."""
    data = np.frombuffer(raw, np.uint8)
    words, _ = word_hashes(data, np.array([0, len(data)]))
    if len(words) < length:
        return words, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram = min(WORD_GRAM, length)
    hashes = _hashes_of(words, gram)
    return words, hashes, least_of_windows(hashes, length - gram + 1)


def run_contexts(raw: bytes, length: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's gram, hash of the context, its first word, how many runs) of the anchors among the wanted.

    The context of an anchor is all words of the runs that have it; equal
    contexts hold the same runs.
    """
    words, hashes, place = _sequence(raw, length)
    at = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
    runs = np.diff(np.append(at, len(place)))
    key = hashes[place[at]]
    some = np.isin(key, wanted)
    key, at, runs = key[some], at[some], runs[some]
    up, down = _power(len(words))
    total = np.append(np.uint64(0), np.cumsum(words * up, dtype=np.uint64))
    whole = mixed((total[at + runs + length - 1] - total[at]) * down[at]) if len(at) else key
    return key, mixed(whole + runs.astype(np.uint64)), at, runs


def _repeated_runs(marked: DataFrame, length: int) -> DataFrame:
    """(rep, tid, lo, hi): words of texts (rep, tid, n, text, keys) covered by runs of ``length`` words that occur again; n copies of a text count n times.

    A context that occurs again holds nothing but repeated runs.  Single runs
    are compared only of anchors that stand in several contexts, and once for
    each of these.  All runs of an anchor hold it, so the first and the last
    repeated one tell what they cover.
    """

    def contexts_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                wanted = np.array(batch.column("keys")[i].as_py(), np.int64).view(np.uint64)
                key, ctx, at, runs = run_contexts(batch.column("text")[i].as_py().encode("utf-8"), length, wanted)
                ids = [pa.array([batch.column(c)[i].as_py()] * len(key), pa.int64()) for c in ("rep", "tid", "n")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(runs.astype(np.int32))], names=["rep", "tid", "n", "key", "ctx", "at", "runs"])

    def runs_of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words, *_ = _sequence(batch.column("text")[i].as_py().encode("utf-8"), length)
                of, asked = _hashes_of(words, length), batch.column("asked")[i].as_py()
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([of[x["at"] : x["at"] + x["runs"]] for x in asked]).view(np.int64)),
                    pa.array(np.repeat([x["ctx"] for x in asked], [x["runs"] for x in asked])),
                    pa.array(np.concatenate([np.arange(x["runs"], dtype=np.int32) for x in asked])),
                    pa.array(np.repeat([x["s"] for x in asked], [x["runs"] for x in asked])),
                ], names=["run", "ctx", "nth", "s"])

    held = staged(map_arrow(marked.select("rep", "tid", "n", "text", "keys"), contexts_of, "rep long, tid long, n long, key long, ctx long, at int, runs int"))
    kinds = staged(held.groupBy("ctx").agg(F.sum("n").alias("s"), F.first("key").alias("key"), F.first("runs").alias("runs"), F.min(F.struct("rep", "tid", "at")).alias("who")))
    several = kinds.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    asked = kinds.join(several, "key", "left_semi").groupBy("who.rep", "who.tid").agg(F.collect_list(F.struct("ctx", "who.at", "runs", "s")).alias("asked"))
    each = marked.select("rep", "tid", "text").join(asked.hint("shuffle_hash"), ["rep", "tid"]).select("text", "asked")
    each = staged(map_arrow(each, runs_of, "run long, ctx long, nth int, s long"), tidy=True)
    twice = each.groupBy("run").agg(F.sum("s").alias("t")).where("t > 1").select("run")
    some = each.where("s = 1").join(twice, "run", "left_semi").groupBy("ctx").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    told = kinds.where("s > 1").select("ctx", F.lit(0).alias("first"), (F.col("runs") - 1).alias("last")).union(some)
    out = staged(held.select("rep", "tid", "ctx", "at").join(told, "ctx").select("rep", "tid", (F.col("at") + F.col("first")).alias("lo"), (F.col("at") + F.col("last") + length).alias("hi")), tidy=True)
    for done in (held, kinds, each):
        release(done)
    return out


def word_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes from the first to the last word of each run of words (first, end)."""
    if not runs:
        return []
    word = np.concatenate([[False], ~_SPACE[np.frombuffer(raw, np.uint8)], [False]])
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(~word[1:] & word[:-1])
    return [(int(starts[lo]), int(ends[hi - 1])) for lo, hi in runs]


def _without(texts: DataFrame, cut_runs: bool) -> DataFrame:
    """(rep, tid, n_removed, n_spans, n_passage, kept, kept_sha256) of rows (rep, tid, text, spans, runs)."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, spans, runs in zip(batch.column("text"), batch.column("spans"), batch.column("runs")):
                raw, at, kept = text.as_py().encode("utf-8"), 0, []
                spans, runs = ([(s["lo"], s["hi"]) for s in x.as_py() or []] for x in (spans, runs))
                runs = merged_spans(word_spans(raw, runs))
                gone = merged_spans(spans + runs if cut_runs else spans)
                for lo, hi in gone:
                    kept.append(raw[at:lo])
                    at = hi
                rest = b"".join([*kept, raw[at:]])
                for to, v in zip(cols, (len(raw) - len(rest), len(gone), sum(hi - lo for lo, hi in runs), rest.decode("utf-8", "ignore"), hashlib.sha256(rest).hexdigest())):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("tid"), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["rep", "tid", "n_removed", "n_spans", "n_passage", "kept", "kept_sha256"])

    return map_arrow(texts, run, "rep long, tid long, n_removed long, n_spans long, n_passage long, kept string, kept_sha256 string")


def remove_repeats(docs: DataFrame, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, cut_runs: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (n_passage if ``words`` is given; kept and text_sha256, the bytes of the input's hash, if asked for).

    Removes each byte covered by a string of LENGTH bytes that also starts
    anywhere else, in the same text or another; with ``words``, also each run
    of so many words (A-Z lowered) that does, unless ``cut_runs`` is false.
    n_passage is how many bytes such runs cover, from their first word to
    their last, cut or not.  Texts are UTF-8 bytes; null is empty.  Strings
    are judged on the input.  ``kept`` is what remains of a text that occurs
    once and from which something was removed, without characters that were
    cut in two; it is null elsewhere: nothing removed, or everything (texts of
    at least LENGTH bytes that occur more than once).  Repeated rows are
    copies of each other.  An empty table stays empty; other columns are not
    looked at.
    """
    nobody = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), nobody).alias("doc_id"), text.alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("tid", F.xxhash64("sha"))
    meta = staged(base.select("doc_id", "tid", F.unhex("sha").alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")))
    classes = staged(meta.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    #: the shortest text that can hold a repeated string, or run of one-letter words
    shortest = min(LENGTH, 2 * words - 1) if words else LENGTH
    reps = classes.where(F.col("n_bytes") >= shortest).select("rep", F.xxhash64(F.lower(F.hex("sha"))).alias("tid"), "n")

    found = _anchor_rows(base.where(F.octet_length("text") >= shortest).select("doc_id", "tid", "text"), words).withColumnRenamed("doc_id", "rep")
    found = staged(found.join(reps, ["rep", "tid"]).dropDuplicates(["rep", "tid"]))
    each = found.select("rep", "tid", F.explode(F.arrays_zip(F.col("grams").alias("gram"), F.col("positions").alias("pos"))).alias("m")).select("rep", "tid", "m.gram", "m.pos")
    again = staged(each.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    marks = each.join(again, "gram", "left_semi").groupBy("rep", "tid").agg(F.collect_list(F.struct("pos", "gram")).alias("marks"))
    own = found.where(F.size("lows") > 0).select("rep", "tid", F.arrays_zip(F.col("lows").alias("lo"), F.col("highs").alias("hi")).alias("own"))
    wanted = marks.join(own, ["rep", "tid"], "full")
    if words:
        keyed = found.select("rep", "tid", "n", F.explode("keys").alias("key"))
        twice = staged(keyed.groupBy("key").agg(F.sum("n").alias("s")).where("s > 1").select("key"))
        keys = keyed.join(twice, "key", "left_semi").groupBy("rep", "tid").agg(F.first("n").alias("n"), F.collect_set("key").alias("keys"))
        wanted = wanted.join(keys, ["rep", "tid"], "full")
    marked = base.withColumnRenamed("doc_id", "rep").select("rep", "tid", "text").join(wanted.hint("shuffle_hash"), ["rep", "tid"])
    if not meta.groupBy("doc_id", "tid").count().where("count > 1").isEmpty():  # a row that is there twice
        marked = marked.dropDuplicates(["rep", "tid"])
    marked = staged(marked, tidy=True)

    contexts = staged(_contexts(marked.where("marks is not null").select("rep", "tid", "text", "marks")))
    spans = contexts.select("rep", "tid", "pos", "gram", "ctx").join(_offsets(contexts), ["gram", "ctx"]).select("rep", "tid", F.struct((F.col("pos") - F.col("most")).cast("int").alias("lo"), (F.col("pos") + LENGTH - F.col("least")).cast("int").alias("hi")).alias("span"))
    spans = staged(spans.groupBy("rep", "tid").agg(F.collect_list("span").alias("spans")), tidy=True)
    release(contexts)
    release(found)
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    runs = none.alias("runs")
    if words:
        again = _repeated_runs(marked.where("keys is not null"), words)
        spans = spans.join(again.groupBy("rep", "tid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), ["rep", "tid"], "full")
        runs = F.coalesce("runs", none).alias("runs")
    cut = marked.select("rep", "tid", "text", "own").join(spans.hint("shuffle_hash"), ["rep", "tid"], "left").select("rep", "tid", "text", F.concat(F.coalesce("own", none), F.coalesce("spans", none)).alias("spans"), runs).where((F.size("spans") > 0) | (F.size("runs") > 0))
    cut = _without(cut, cut_runs)
    if not keep_text:
        cut = cut.drop("kept")
    cut = staged(cut)

    copied = (F.col("n") > 1) & (F.col("n_bytes") >= LENGTH)
    by_class = classes.withColumn("tid", F.xxhash64(F.lower(F.hex("sha")))).join(cut, ["rep", "tid"], "left").select(
        "sha", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *([F.coalesce("n_passage", F.lit(0)).alias("n_passage")] if words else []),
        *([F.when(~copied, F.col("kept")).alias("kept")] if keep_text else []),
    )
    out = meta.select("doc_id", "sha", "n_bytes").join(by_class, ["sha", "n_bytes"])
    extra = ["n_passage"] * bool(words) + ["kept", F.col("sha").alias("text_sha256")] * keep_text
    return out.select(F.nullif(F.col("doc_id"), nobody).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *extra)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
