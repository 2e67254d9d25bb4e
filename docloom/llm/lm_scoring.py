"""Language-model scores by a weighted backoff automaton over n-grams.

A state is a gram of the training texts that can be a context.  Its arc for a
word seen behind it carries the log-probability of that word and leads to the
longest known context then; its failure arc carries the weight that is left to
unseen words and leads to the state one word shorter, down to the root, whose
arcs are smoothed word counts.  Every text is read once from left to right: a
state is carried along, and the weights of the arcs taken are added up.

Counts grow with the corpus, so they never leave the executors: texts are dealt
into chunks of bounded bytes, a chunk sends the sorted keys of its own grams,
and the corpus counts come back in the order in which they were asked for.  A
slice of a chunk then builds the part of the automaton that its own texts can
reach, and walks it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_arrow, table, text_slices
from .shingles import mixed, word_hashes

ORDER = 3
#: Occurrences of a context that its shorter context is worth.
PRIOR = 30.0
#: Bytes of text that one task scores at a time, and that give the keys which one task counts at a time, about.
CHUNK_BYTES, PART_BYTES = 8 << 20, 4 << 20
#: Bits of a word's key; a longer gram's has so many more than the corpus has bytes, so the chance that it shares its key stays the same.
WORD_BITS, SPARE_BITS = 63, 16
#: Distinct words that one task holds before it hands on what it has.
HELD = 3_000_000
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_SLICE = 1 << 20
#: Words of a text that are read one after the other; longer texts are read in several stretches.
STRETCH = 512


# -- sequences ---------------------------------------------------------------------


def sequences(texts: pa.Array):
    """(words of a slice, words before each of its texts) slice by slice."""
    for a, b, raw, off in text_slices(texts, _SLICE):
        words, before = word_hashes(raw, off)
        yield a, b, words, before


def framed(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(START, words, END of every text end to end, place of each START)."""
    n = len(before) - 1
    out = np.empty(len(words) + 2 * n, np.uint64)
    starts = before[:-1] + 2 * np.arange(n)
    ends = before[1:] + 2 * np.arange(n) + 1
    mask = np.ones(len(out), bool)
    mask[starts] = mask[ends] = False
    out[starts], out[ends], out[mask] = START, END, words
    return out, starts


def grams(seq: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order up to this one, (hash of the gram that ends at each place, whether one does).

    START begins a text and ends no gram; START and END alone are no words.
    """
    before, there = seq, np.ones(len(seq), bool)
    out = [(seq, (seq != START) & (seq != END))]
    for _ in range(1, order):
        keys, ok = np.zeros(len(seq), np.uint64), np.zeros(len(seq), bool)
        x = before[:-1] * np.uint64(0xD6E8FEB86659FD93) + seq[1:]
        keys[1:] = mixed(x ^ (x >> np.uint64(32)))
        ok[1:] = there[:-1] & (seq[1:] != START)
        out.append((keys, ok))
        before, there = keys, ok
    return out


# -- keys on their way ---------------------------------------------------------------


def packed(values: np.ndarray) -> bytes:
    """Unsigned values as planes of their bits, as many as the greatest needs; short lists as they are."""
    if len(values) < 64:
        return b"\0" * (len(values) > 0) + values.astype("<u8").tobytes()
    planes = max(1, int(values.max()).bit_length())
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - planes :]
    return bytes([planes]) + len(values).to_bytes(4, "little") + np.packbits(np.ascontiguousarray(bits.T), axis=1).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    planes = data[0]
    if not planes:
        return np.frombuffer(data, "<u8", offset=1).astype(np.uint64)
    n = int.from_bytes(data[1:5], "little")
    bits = np.zeros((n, 64), np.uint8)
    bits[:, 64 - planes :] = np.unpackbits(np.frombuffer(data, np.uint8, offset=5).reshape(planes, -1), axis=1)[:, :n].T
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct keys by their distances; the first is meant from the start of its part."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint64)


def tally(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys ascending, how many of each are not held out); keys have 63 bits at most."""
    x = np.sort((keys << np.uint64(1)) | held.astype(np.uint64))
    key = x >> np.uint64(1)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    learned = np.append(0, np.cumsum((x & np.uint64(1)) == 0))
    return key[starts], np.diff(learned[np.append(starts, len(key))]).astype(np.uint64)


def part_edges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the keys of each of ``parts`` equal ranges begin, and the end; parts are a power of two."""
    width = bits - (parts.bit_length() - 1)
    return np.append(np.searchsorted(keys, np.arange(parts, dtype=np.uint64) << np.uint64(width)), len(keys)) if parts > 1 else np.array([0, len(keys)])


def joint_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """The sum of the counts of each key over all lists, in the order of each list."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    ranked = every[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(every) else np.zeros(0, np.int64)
    if not len(every):
        return counts
    sums = np.add.reduceat(np.concatenate(counts)[order], starts)
    out = np.empty(len(every), np.uint64)
    out[order] = np.repeat(sums, np.diff(np.append(starts, len(every))))
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


# -- over the corpus -----------------------------------------------------------------


def _vocabulary(docs: DataFrame, parts: int) -> tuple[int, int]:
    """(words, distinct words) of the texts."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out():
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)
            edges = part_edges(keys, WORD_BITS, parts)
            some = np.flatnonzero(np.diff(edges))
            width = np.uint64(WORD_BITS - (parts.bit_length() - 1))
            blobs = [packed_keys(keys[edges[p] : edges[p + 1]] - (np.uint64(p) << width)) for p in some]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(blobs, pa.binary()), pa.array([int(n[edges[p] : edges[p + 1]].sum()) for p in some], pa.int64())], names=["part", "keys", "n"])

        for batch in batches:
            for _, _, words, _ in sequences(batch.column("text")):
                if len(words):
                    held.append(np.unique(words >> np.uint64(1), return_counts=True))
                    size += len(held[-1][0])
                if size > HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def distinct(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpacked_keys(x.as_py()) for x in t["keys"]]))
        return pa.table([pa.array([sum(t["n"].to_pylist())], pa.int64()), pa.array([len(keys)], pa.int64())], names=["n", "v"])

    each = map_arrow(docs.select("text"), run, "part long, keys binary, n long").groupBy("part").applyInArrow(distinct, "n long, v long")
    return tuple(each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first())


def _of_chunk(docs: pa.Table, order: int, bits: int):
    """(framed words, places of STARTs, whether each place is held out, its grams) slice by slice, keys cut to their bits."""
    hold = docs["held_out"].to_numpy(zero_copy_only=False)
    for a, b, words, before in sequences(docs["text"]):
        seq, starts = framed(words, before)
        found = [(k >> np.uint64(64 - (bits if level else WORD_BITS)), ok) for level, (k, ok) in enumerate(grams(seq, order))]
        yield seq, starts, np.repeat(hold[a:b], np.diff(np.append(starts, len(seq)))), found


def _joined(found: list, levels: range) -> np.ndarray:
    """The keys of those levels that are there, level by level within each slice."""
    return np.concatenate([k[ok] for slice_ in found for k, ok in (slice_[i] for i in levels)] or [np.zeros(0, np.uint64)])


_ASKED = "chunk int, part long, words binary, word_n binary, grams binary, gram_n binary"


def _asked(chunked: DataFrame, order: int, bits: int, parts: int) -> DataFrame:
    """The keys of each chunk's words and longer grams, part by part, with the chunk's own training counts."""

    def ask(docs: pa.Table) -> pa.Table:
        slices = list(_of_chunk(docs, order, bits))
        cols: list[list] = [[], [], [], []]
        some = np.zeros(parts, bool)
        for i, (levels, width) in enumerate(((range(1), WORD_BITS), (range(1, order), bits))):
            hold = np.concatenate([h[s[k][1]] for _, _, h, s in slices for k in levels] or [np.zeros(0, bool)])
            keys, n = tally(_joined([s for *_, s in slices], levels), hold)
            edges = part_edges(keys, width, parts)
            some |= np.diff(edges) > 0
            shift = np.uint64(width - (parts.bit_length() - 1))
            cols[2 * i] = [packed_keys(keys[a:b] - (np.uint64(p) << shift)) if b > a else b"" for p, (a, b) in enumerate(zip(edges, edges[1:]))]
            cols[2 * i + 1] = [packed(n[a:b]) for a, b in zip(edges, edges[1:])]
        at = np.flatnonzero(some)
        arrays = [pa.array([docs["chunk"][0].as_py()] * len(at), pa.int32()), pa.array(at.astype(np.int64)), *(pa.array([c[p] for p in at], pa.binary()) for c in cols)]
        return pa.Table.from_arrays(arrays, names=["chunk", "part", "words", "word_n", "grams", "gram_n"])

    return chunked.groupBy("chunk").applyInArrow(ask, _ASKED)


def _answered(asked: DataFrame) -> DataFrame:
    """(chunk, part, word_c, gram_c): the corpus counts of what a chunk asked for, in its order."""

    def answer(t: pa.Table) -> pa.Table:
        out = []
        for keys, n in (("words", "word_n"), ("grams", "gram_n")):
            got = joint_counts([unpacked_keys(x.as_py()) for x in t[keys]], [unpacked(x.as_py()) for x in t[n]])
            out.append(pa.array([packed(c) for c in got], pa.binary()))
        return pa.Table.from_arrays([t["chunk"].combine_chunks(), t["part"].combine_chunks(), *out], names=["chunk", "part", "word_c", "gram_c"])

    return asked.groupBy("part").applyInArrow(answer, "chunk int, part long, word_c binary, gram_c binary")


class Automaton:
    """The states and arcs that the texts of a slice can reach.

    ``counts`` has the corpus count of the gram of each order that ends at each
    place.  State 0 is the root; then come words, then longer grams, order by
    order.  Arcs are kept by (state, word), ascending.
    """

    def __init__(self, seq, starts, found, counts, total: int, distinct: int, texts: int, prior: float):
        vocabulary, self.word = np.unique(seq, return_inverse=True)
        n = counts[0].astype(np.float64)
        n[seq == END], n[starts] = texts, 0
        self.known, self.words = n > 0, len(vocabulary)
        p = (n + 1.0) / (total + distinct + 1.0)
        self.base = np.log10(p)
        n[starts] = texts
        #: at each place: the state of the longest known context that ends there; words are contexts from order 2 on
        at = np.where(n > 0, 1 + self.word, 0) * (len(found) > 1)
        self.root_weight, self.root_to = (np.zeros(self.words, t) for t in (np.float64, np.int64))
        self.root_weight[self.word], self.root_to[self.word] = self.base, at
        fail, left = [np.zeros(1 + self.words, np.int64)], [np.zeros(1 + self.words)]
        with np.errstate(divide="ignore"):
            left[0][1 + self.word] = np.log10(prior / (n + prior))
            size, of_level = 1 + self.words, np.where(n > 0, 1 + self.word, -1)
            arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for level in range(1, len(found)):
                keys, ok = found[level]
                c = counts[level].astype(np.float64)
                seen = np.flatnonzero(ok & (c > 0))
                p[1:] = np.where(ok[1:], (c[1:] + prior * p[1:]) / (n[:-1] + prior), p[1:])
                source = of_level[seen - 1]
                own = np.full(len(seq), -1)  # the state of the gram that ends at each place
                if level < len(found) - 1:  # these grams are contexts, too
                    distinct_keys, first, which = np.unique(keys[seen], return_index=True, return_inverse=True)
                    own[seen] = size + which
                    fail.append(at[seen[first]])
                    left.append(np.log10(prior / (c[seen[first]] + prior)))
                    size += len(distinct_keys)
                    at = np.where(own >= 0, own, at)
                arcs.append((source * self.words + self.word[seen], np.log10(p[seen]), at[seen]))
                n, of_level = c, own
        self.fail, self.left = np.concatenate(fail), np.concatenate(left)
        keys, weights, to = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(zip(*arcs) if arcs else ((), (), ()), (np.int64, np.float64, np.int64)))
        self.arcs, first = np.unique(keys, return_index=True)
        self.weights, self.to = weights[first], to[first]
        self.begin = int(at[starts[0]]) if len(starts) else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, next state) of reading a word in each state: its arc, or the failure arcs down to a state that has one."""
        weight, out = np.zeros(len(state)), np.empty(len(state), np.int64)
        open_, state = np.arange(len(state)), state.copy()
        while len(open_):
            now = state[open_]
            root = now == 0
            done = open_[root]
            weight[done] += self.root_weight[word[done]]
            out[done] = self.root_to[word[done]]
            open_, now = open_[~root], now[~root]
            key = now * self.words + word[open_]
            place = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[place] == key if len(self.arcs) else np.zeros(len(key), bool)
            done = open_[hit]
            weight[done] += self.weights[place[hit]]
            out[done] = self.to[place[hit]]
            open_, now = open_[~hit], now[~hit]
            weight[open_] += self.left[now]
            state[open_] = self.fail[now]
        return weight, out


def walked(seq, starts, automaton: Automaton, order: int) -> np.ndarray:
    """The log10 weight of each token, texts read from left to right, many at once.

    A long text is read in stretches.  One that begins inside a text first
    reads the ``order`` - 1 words before it, which decide the state there.
    """
    ends = np.append(starts, len(seq))[1:]
    first = [np.arange(s + 1, e, STRETCH) for s, e in zip(starts, ends)]
    begin = np.concatenate(first) if first else np.zeros(0, np.int64)
    end = np.concatenate([np.append(f, e)[1:] for f, e in zip(first, ends)]) if first else begin
    inside = np.ones(len(begin), bool)
    inside[np.cumsum([0, *map(len, first)])[:-1]] = False
    at = np.where(inside, begin - (order - 1), begin)
    by = np.argsort(at - end, kind="stable")  # longest first
    begin, end, at, inside = begin[by], end[by], at[by], inside[by]
    state = np.where(inside, 0, automaton.begin)
    out = np.zeros(len(seq))
    while len(at):
        weight, state = automaton.step(state, automaton.word[at])
        told = at >= begin
        out[at[told]] = weight[told]
        at = at + 1
        going = int(np.searchsorted(at - end, 0))
        at, end, begin, state = at[:going], end[:going], begin[:going], state[:going]
    return out


def score_documents(docs: DataFrame, held_out, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain of every row.

    Learns from the rows that are not held out, all of them; ``held_out`` is a
    boolean column of ``docs``, null counts as false.  Tokens are the words
    (A-Z lowered) and one end.  base_score is the sum of log10((c + 1) / (N +
    V + 1)).  score is the model's log10 probability: from a context seen n
    times, a token seen c times behind it has (c + prior * q) / (n + prior), q
    being its probability from the context one word shorter, and the base at
    the end; every gram counts, however rare.  gain is (score - base_score)
    per token.  A null text is empty and has one token, the end.  Repeated
    rows are scored and counted each for itself, rows without an id as well.
    Nothing to learn from: every token has probability 1.  An empty table
    stays empty; other columns are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    texts, size = docs.agg(F.count_if(~F.col("held_out")), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks, parts = max(1, -(-size // CHUNK_BYTES)), 1 << max(0, math.ceil(math.log2(max(1, size / PART_BYTES))))
    bits = min(WORD_BITS, max(1, size).bit_length() + SPARE_BITS)
    total, distinct = _vocabulary(docs.where(~F.col("held_out")), parts)
    total, distinct = total + texts, distinct + (texts > 0)

    #: rows without an id or with one id may be many, so the place of a row deals as well
    chunked = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")).repartition("chunk")
    answers = _answered(_asked(chunked, order, bits, parts))

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        slices = list(_of_chunk(docs, order, bits))
        known = known.sort_by("part")
        everywhere = []
        for name, levels in (("word_c", range(1)), ("gram_c", range(1, order))):
            keys = _joined([s for *_, s in slices], levels)
            by = np.argsort(keys)
            ranked = keys[by]
            nth = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
            count = np.concatenate([unpacked(x.as_py()) for x in known[name]] or [np.zeros(0, np.uint64)])
            at = np.empty(len(keys), np.uint64)
            at[by] = count[nth]
            everywhere.append(at)
        taken = [0, 0]
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for seq, starts, _, found in slices:
            counts = []
            for level, (_, ok) in enumerate(found):
                kind, m = min(level, 1), int(ok.sum())
                c = np.zeros(len(seq), np.uint64)
                c[ok] = everywhere[kind][taken[kind] : taken[kind] + m]
                taken[kind] += m
                counts.append(c)
            automaton = Automaton(seq, starts, found, counts, total, distinct, texts, prior)
            seen, base, weight = automaton.known, automaton.base, walked(seq, starts, automaton, order)
            base[starts] = 0
            cols[0].append(np.diff(np.append(starts, len(seq))) - 1)
            for to, v in zip(cols[1:], (seen.astype(np.int64), base, weight)):
                to.append(np.add.reduceat(v, starts))
        n, seen, base, weight = (np.concatenate(x) if x else np.zeros(0) for x in cols)
        return pa.table(
            [docs["doc_id"].combine_chunks(), docs["held_out"].combine_chunks(), pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(np.full(len(docs), total, np.int64)), *(pa.array(x.astype(np.float64)) for x in (base, weight, (weight - base) / np.maximum(n, 1)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "gain"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, gain double"
    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)
