"""Quality rules over whole texts: plain counts, and a linear-chain conditional random field over a text's lines."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, staged, table, text_slices
from .shingles import CASED, shingle_hashes, span_hashes, word_spans

#: Words of a window that counts as repeated, and the plain rules: fewest words, most per cent of repeated words.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A document stays if so many per cent of its words stand in lines of content.
LEAST_CONTENT = 50
#: The fit reads about so many labelled documents of either quality, and about so many segments of at most SEGMENT lines of them.
FIT_DOCUMENTS, FIT_SEGMENTS, SEGMENT = 1500, 2000, 32
#: Steps and step size of the fit, and the weight of the squared coefficients.
STEPS, RATE, RIDGE = 200, 0.1, 1e-4
CONTENT, BOILERPLATE = 0, 1

#: What is seen of a line, and where its values are cut into bins.
BINS = {
    "words": [2, 4, 8, 16, 32],
    "letter_share": [0.4, 0.6, 0.75, 0.85, 0.95],
    "capital_share": [1e-9, 0.1, 0.3, 0.6],
    "symbols_a_word": [1e-9, 0.05, 0.2, 0.5],
    "digit_share": [1e-9, 0.05, 0.2],
    "exclamations_a_word": [1e-9, 0.2, 0.5],
    "letters_a_word": [2.5, 4, 8, 12],
    "ends_sentence": [0.5],
    "begins_with_mark": [0.5],
    "seen_before": [0.5],
    "repeated_share": [1e-9, 0.1, 0.3, 0.6],
}
_FIRST = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS.values()])])


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _DIGIT, _EXCLAMATION, _END, _MARK = (_bytes(c) for c in ("#*$%&|<>", "0123456789", "!", ".!?", "#*$%&|<>-=+~_"))
_CAPITAL = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: one byte of each letter: ASCII letters, and the first byte of what is not ASCII
_LETTER = _CAPITAL | _bytes("abcdefghijklmnopqrstuvwxyz")
_LETTER[0xC0:] = True
_CHARACTER = np.ones(256, bool)
_CHARACTER[0x80:0xC0] = False


# -- counts and lines --------------------------------------------------------------------


class Slice:
    """Counts of the texts of a slice, and what is seen of their lines."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.texts = len(offsets) - 1
        starts, ends = word_spans(raw, offsets)
        at = np.searchsorted(starts, offsets)
        text = np.repeat(np.arange(self.texts), np.diff(at))
        sums = {k: np.concatenate([[0], np.cumsum(m[raw])]) for k, m in (("char", _CHARACTER), ("symbol", _SYMBOL), ("digit", _DIGIT), ("!", _EXCLAMATION), ("capital", _CAPITAL), ("letter", _LETTER))}
        chars = sums["char"][ends] - sums["char"][starts]
        repeated = self._repeated(span_hashes(raw, starts, ends, CASED), text)
        self.n_words = np.diff(at)
        self.word_chars = np.bincount(text, chars, self.texts).astype(np.int64)
        self.n_symbols = np.diff(sums["symbol"][offsets])
        self.n_repeat_words = np.bincount(text[repeated], minlength=self.texts)

        #: lines with a word, in order
        line_at = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(raw == 0x0A) + 1]))
        line_at = line_at[line_at < len(raw)]
        of_word = np.searchsorted(line_at, starts, "right") - 1
        lines, first, words = np.unique(of_word, return_index=True, return_counts=True)
        begin, end = line_at[lines], np.append(line_at, len(raw))[lines + 1]
        end = end - (raw[end - 1] == 0x0A) if len(end) else end
        self.line_text, self.line_words = text[first], words
        before = self._seen_before(span_hashes(raw, begin, end, CASED), self.line_text)
        self.n_dup_lines = np.bincount(self.line_text[before], minlength=self.texts)
        self.n_lines = np.bincount(self.line_text, minlength=self.texts)
        if not len(lines):
            self.lines = np.zeros((0, len(BINS)), np.uint8)
            return
        n = {k: s[end] - s[begin] for k, s in sums.items()}
        inked, letters = np.maximum(np.add.reduceat(chars, first), 1), np.maximum(n["letter"], 1)
        seen = {
            "words": words, "letter_share": n["letter"] / inked, "capital_share": n["capital"] / letters, "symbols_a_word": n["symbol"] / words, "digit_share": n["digit"] / inked,
            "exclamations_a_word": n["!"] / words, "letters_a_word": n["letter"] / words, "ends_sentence": _END[raw[ends[first + words - 1] - 1]], "begins_with_mark": _MARK[raw[starts[first]]],
            "seen_before": before, "repeated_share": np.add.reduceat(repeated.astype(np.int64), first) / words,
        }
        self.lines = np.stack([np.searchsorted(b, seen[k], "right") + _FIRST[i] for i, (k, b) in enumerate(BINS.items())], axis=1).astype(np.uint8)

    @staticmethod
    def _repeated(words: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which words stand in a window of WINDOW words that its text holds twice or more."""
        n = len(words) - WINDOW + 1
        if n < 1:
            return np.zeros(len(words), bool)
        whole = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
        windows = shingle_hashes(words, WINDOW)[whole] ^ (text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, which, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = whole[counts[which] > 1]
        depth = np.zeros(len(words) + 1, np.int64)
        depth[twice] += 1
        depth[twice + WINDOW] -= 1
        return np.cumsum(depth[:-1]) > 0

    @staticmethod
    def _seen_before(lines: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Which lines equal an earlier line of their text."""
        _, first = np.unique(lines ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        out = np.ones(len(lines), bool)
        out[first] = False
        return out


# -- the conditional random field --------------------------------------------------------


@dataclass
class Model:
    """Scores of a line's bins, of a label after a label, and of a first label; None where nothing was labelled."""

    bins: np.ndarray
    after: np.ndarray
    first: np.ndarray


class Chains:
    """Chains of lines laid end to end, walked place by place over all chains at once, longest first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.sorted = lengths[self.order]
        self.begin = (np.cumsum(lengths) - lengths)[self.order]
        self.longest = int(self.sorted[0]) if len(lengths) else 0
        self.going = np.searchsorted(-self.sorted, -np.arange(self.longest), "left")  # chains that have a line at each place

    def rows(self, place: int) -> np.ndarray:
        return self.begin[: self.going[place]] + place


def viterbi(model: Model, lines: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest labels of the lines of all chains; ties go to content."""
    chains, emit = Chains(lengths), model.bins[lines].sum(1)
    back, out = np.zeros(emit.shape, np.int8), np.zeros(len(lines), np.int8)
    last = np.zeros((len(lengths), emit.shape[1]))
    for place in range(chains.longest):
        rows = chains.rows(place)
        if place == 0:
            now = model.first + emit[rows]
        else:
            reached = now[: len(rows), :, None] + model.after
            back[rows] = reached.argmax(1)
            now = reached.max(1) + emit[rows]
        last[: len(rows)] = now
    label = last.argmax(1)
    for place in reversed(range(chains.longest)):
        rows = chains.rows(place)
        out[rows] = label[: len(rows)]
        label[: len(rows)] = back[rows, label[: len(rows)]]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def expected(model: Model, lines: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of each label of each line, expected label pairs, expected first labels) by forward and backward sums."""
    emit = model.bins[lines].sum(1)
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    for place in range(chains.longest):
        rows = chains.rows(place)
        ahead[rows] = emit[rows] + (model.first if place == 0 else _log_sum(ahead[rows - 1][:, :, None] + model.after, 1))
    total = np.zeros(len(chains.order))
    pairs = np.zeros_like(model.after)
    for place in reversed(range(chains.longest)):
        rows = chains.rows(place)
        ended = slice(chains.going[place + 1] if place + 1 < chains.longest else 0, len(rows))
        total[ended] = _log_sum(ahead[rows[ended]], 1)
        if place + 1 < chains.longest:
            nxt = chains.rows(place + 1)
            here = nxt - 1
            onward = model.after + (emit[nxt] + behind[nxt])[:, None, :]
            behind[here] = _log_sum(onward, 2)
            pairs += np.exp(ahead[here][:, :, None] + onward - total[: len(nxt), None, None]).sum(0)
    whole = np.zeros(len(lines))
    for place in range(chains.longest):
        whole[chains.rows(place)] = total[: chains.going[place]]
    chance = np.exp(ahead + behind - whole[:, None])
    return chance, pairs, chance[chains.begin[chains.sorted > 0]].sum(0)


def trained(lines: np.ndarray, lengths: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> Model:
    """The model of greatest likelihood with a ridge, by gradient ascent with adapted steps; ``labels`` are of lines."""
    chains = Chains(lengths)
    model = Model(np.zeros((_FIRST[-1], 2)), np.zeros((2, 2)), np.zeros(2))
    parts = ("bins", "after", "first")

    def counts(chance, pairs, first):
        bins = np.stack([np.bincount(lines.ravel(), np.repeat(chance[:, k], lines.shape[1]), _FIRST[-1]) for k in range(2)], axis=1)
        return {"bins": bins, "after": pairs, "first": first}

    chosen = np.eye(2)[labels]
    begins = np.zeros(len(lines), bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    onward = ~begins[1:]
    pairs = np.zeros((2, 2))
    np.add.at(pairs, (labels[:-1][onward], labels[1:][onward]), 1)
    seen = counts(chosen, pairs, chosen[begins].sum(0))
    mean = {k: np.zeros_like(getattr(model, k)) for k in parts}
    spread = {k: np.zeros_like(getattr(model, k)) for k in parts}
    for step in range(1, steps + 1):
        now = counts(*expected(model, lines, chains))
        for k in parts:
            slope = (seen[k] - now[k]) / max(len(lines), 1) - RIDGE * getattr(model, k)
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            spread[k] = 0.999 * spread[k] + 0.001 * slope**2
            move = RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)
            setattr(model, k, getattr(model, k) + move)
    return model


def labelled_lines(lines: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of lines from those of their documents: what a line's own bins say, learned from all lines alone.

    A bad document can hold good lines; told apart, they show the model where
    labels change.  If all lines came out alike, documents' labels stay.
    """
    alone = np.ones(len(lines), np.int64)
    own = viterbi(trained(lines, alone, labels), lines, alone)
    return own if 0 < own.sum() < len(own) else labels


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, segments: int = FIT_SEGMENTS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """Learn from about ``documents`` labelled documents of either quality, ``segments`` segments of their lines.

    A label above 0 is content, else boilerplate; lines get theirs by
    :func:`labelled_lines`.  Documents and segments are taken by a hash of the id, so
    reruns agree.  A null label or id is not used; without labels, or with
    one kind only, there is no model.
    """
    good = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).alias("good"))
    counted = {r["good"]: r["n"] for r in good.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counted) < 2:
        return None

    def about(most: int, of: dict, *by) -> F.Column:
        share = F.when(F.col("good"), min(1.0, most / of[True])).otherwise(min(1.0, most / of[False]))
        return F.pmod(F.xxhash64(*by), F.lit(1 << 20)) < share * (1 << 20)

    sample = good.where(about(documents, counted, "id"))  # about 2 x documents rows, whatever the table holds
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("good", "id", "text")

    def cut(batches):
        for batch in batches:
            flags = batch.column(0).to_pylist()
            for a, _, raw, offsets in text_slices(batch.column(2)):
                s = Slice(raw, offsets)
                ends = np.cumsum(s.n_lines)
                got = [(flags[a + i], a + i, k, s.lines[k : min(k + SEGMENT, e)].tobytes()) for i, e in enumerate(ends) for k in range(e - s.n_lines[i], e, SEGMENT)]
                who = batch.column(1).take(pa.array([g[1] for g in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.bool_()), who, pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.binary())], names=["good", "id", "at", "lines"])

    pieces = staged(map_arrow(texts, cut, f"good boolean, id {dict(texts.dtypes)['id']}, at long, lines binary"))
    of = {r["good"]: r["n"] for r in pieces.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(of) < 2:
        return None
    got = sorted(pieces.where(about(segments, of, "id", "at", "lines")).select("good", "lines").collect())
    lengths = np.array([len(r["lines"]) // len(BINS) for r in got], np.int64)
    lines = np.frombuffer(b"".join(bytes(r["lines"]) for r in got), np.uint8).reshape(-1, len(BINS))
    of_line = np.repeat([CONTENT if r["good"] else BOILERPLATE for r in got], lengths)
    return trained(lines, lengths, labelled_lines(lines, of_line))


# -- documents ----------------------------------------------------------------------------


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_content of every row.

    ``n_content`` counts the words in lines that the decoded label sequence
    calls content.  A row is kept unless the plain rules fail it or under
    LEAST_CONTENT per cent of its words are content.  Null and empty texts
    have no words and fail.  Without a model every line is content.  Rows are
    worked on one by one: repeated rows stay, an empty table stays empty,
    other columns are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        model = held.value
        for batch in batches:
            for a, b, raw, offsets in text_slices(batch.column(1)):
                s = Slice(raw, offsets)
                content = viterbi(model, s.lines, s.n_lines) == CONTENT if model is not None and len(s.lines) else np.ones(len(s.lines), bool)
                n_content = np.bincount(s.line_text[content], s.line_words[content], s.texts).astype(np.int64)
                failed = (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > MOST_REPEATED * s.n_words)
                kept = ~failed & (100 * n_content >= LEAST_CONTENT * s.n_words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(getattr(s, c).astype(np.int64)) for c in names), pa.array(failed), pa.array(kept), pa.array(n_content)], names=["doc_id", *names, "base_failed", "kept", "n_content"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, {', '.join(f'{c} long' for c in names)}, base_failed boolean, kept boolean, n_content long")


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
