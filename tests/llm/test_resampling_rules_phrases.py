"""Importance resampling, quality rules and collocations against plain restatements."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import collocations as col
from docloom.llm import importance_resampling as res
from docloom.llm import quality_rules as qr

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- importance resampling ----------------------------------------------------------------


def plain_features(text, longest, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    own, wanted = [(i, *plain_features(t, longest, buckets)) for i, t in rows], Counter()
    for t in target:
        wanted.update(plain_features(t, longest, buckets)[1])
    raw = Counter(b for _, _, f in own for b in f)
    s_all, t_all = float(raw.total() + buckets), float(wanted.total() + buckets)
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * s_all / ((raw[b] + 1.0) * t_all))) for b in raw}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


@pytest.fixture(scope="module")
def target(spark):
    rng = random.Random(3)
    rows = [" ".join(f"w{rng.randrange(60)}" for _ in range(30)) for _ in range(9)] + [None, "", "W1 w1, là"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_id long, text string")


@pytest.mark.parametrize("longest, percent, heavy", [(1, 10, 1000), (1, 50, 20), (2, 30, 1), (3, 100, 40)])
def test_resample_equals_a_plain_restatement(documents, corpus, target, monkeypatch, longest, percent, heavy):
    monkeypatch.setattr(res, "HEAVY", heavy)  # texts on either way back to their rows
    got = res.resample(documents, target, longest=longest, percent=percent, buckets=500).collect()
    want = plain_resample([(r[0], r[1]) for r in corpus], [r.text for r in target.collect()], longest, 500, percent=percent)
    assert sorted([tuple(r) for r in got], key=str) == want
    assert sum(r["rank"] is not None for r in got) == percent * sum(plain_features(r[1], 1, 500)[0] >= 20 for r in corpus) // 100


def test_resample_odd_tables(spark, documents, corpus, clashing, empty, target):
    assert res.resample(empty, target).collect() == []
    plain = sorted(map(tuple, res.resample(documents, target).collect()), key=str)
    assert sorted(map(tuple, res.resample(clashing, target).collect()), key=str) == plain
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(tuple, res.resample(documents, none).collect()), key=str) == plain_resample([(r[0], r[1]) for r in corpus], [])
    long = " ".join(f"w{k}" for k in range(30))
    rows = spark.createDataFrame([(None, long), (None, long), (3, long), (3, long), (4, None), (None, None)], "doc_id long, text string")
    got = res.resample(rows, target, percent=100).collect()
    assert len(got) == 6 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4] and all(r["rank"] is None for r in got if not r.n_features)


# -- quality rules ------------------------------------------------------------------------


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated), failed


LINES = ["Menu | Home | Login", "one two three four five six seven eight nine.", "là où ÇA été, dit-il.", "", "   ", "日本語 の 文章", "!!! BUY $$$ NOW ###", "a\tb\x0bc\r"]


def line_texts(n=60, seed=5):
    rng = random.Random(seed)
    return ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_plain_counts(spark, corpus):
    texts = [r[1] for r in corpus] + line_texts() + ["a b c d e f g h " * 3, "\n\n\n", "\nx", "x\n"]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), None).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i])[1:7] == plain_rules(t), t
        assert got[i].kept == (not got[i].base_failed) and got[i].n_content == got[i].n_words


def test_lines_do_not_cross_texts():
    """Texts laid end to end give what each gives alone."""
    texts = [t.encode() for t in line_texts(40, 8)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = qr.Slice(np.frombuffer(b"".join(texts), np.uint8), offsets)
    alone = [qr.Slice(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    assert np.array_equal(whole.lines, np.concatenate([s.lines for s in alone]))
    assert whole.n_lines.tolist() == [s.n_lines[0] for s in alone] and whole.line_words.tolist() == [w for s in alone for w in s.line_words]


def some_model(seed):
    rng = np.random.default_rng(seed)
    return qr.Model(rng.normal(size=(qr._FIRST[-1], 2)), rng.normal(size=(2, 2)) * 2, rng.normal(size=2))


def chains_of(seed, lengths):
    rng = np.random.default_rng(seed)
    top = np.diff(qr._FIRST)
    return (rng.integers(0, top, (sum(lengths), len(top))) + qr._FIRST[:-1]).astype(np.uint8), np.array(lengths)


def value(model, lines, labels):
    out = sum(model.bins[l].sum(0)[y] for l, y in zip(lines, labels)) + (model.first[labels[0]] if len(labels) else 0)
    return out + sum(model.after[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_decoding_and_chances_equal_all_sequences(seed):
    model, (lines, lengths) = some_model(seed), chains_of(seed, [0, 5, 1, 7, 0, 3, 7])
    got, (chance, pairs, first) = qr.viterbi(model, lines, lengths), qr.expected(model, lines, qr.Chains(lengths))
    at, want_pairs, want_first = 0, np.zeros((2, 2)), np.zeros(2)
    for n in lengths:
        own = lines[at : at + n]
        ways = list(itertools.product((0, 1), repeat=int(n)))
        values = np.array([value(model, own, w) for w in ways])
        assert tuple(got[at : at + n]) == ways[int(values.argmax())]
        share = np.exp(values - values.max()) / np.exp(values - values.max()).sum()
        for k in range(n):
            assert chance[at + k, 1] == pytest.approx(sum(p for p, w in zip(share, ways) if w[k]))
        for p, w in zip(share, ways):
            for a, b in zip(w, w[1:]):
                want_pairs[a, b] += p
            if n:
                want_first[w[0]] += p
        at += n
    assert np.allclose(pairs, want_pairs) and np.allclose(first, want_first)


def test_ties_are_content():
    lines, lengths = chains_of(1, [4])
    assert qr.viterbi(qr.Model(np.zeros((qr._FIRST[-1], 2)), np.zeros((2, 2)), np.zeros(2)), lines, lengths).tolist() == [0] * 4


@pytest.fixture(scope="module")
def labelled(spark):
    """Prose, junk, and texts of both; odd ids are labelled."""
    rng = random.Random(11)
    prose = lambda: " ".join(rng.choice(["the", "river", "runs", "slowly", "under", "old", "bridges"]) + str(rng.randrange(99)) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["###", "$$$ BUY", "| HOME", "%%% WIN!!", "*** CLICK"]) + rng.choice("ABCDEF") for _ in range(9))
    rows = [(i, "\n".join((junk if i % 4 < 2 and k < (8 if i % 8 < 4 else 6) else prose)() for k in range(8)), int(i % 4 >= 2)) for i in range(240)]
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2], "doc_id long, quality int"), rows


def test_content_share_decides(labelled):
    docs, labels, rows = labelled
    model = qr.fit(docs, labels)
    got = {r.doc_id: r for r in qr.judge(docs, model).collect()}
    held_out = [r for r in rows if r[0] % 2 == 0]
    assert all(got[i].kept == bool(q) for i, _, q in held_out)
    assert all(got[i].n_content == got[i].n_words for i, _, q in held_out if q)
    mixed = [got[i] for i, _, q in held_out if not q and i % 8 >= 4]
    assert mixed and all(0 < r.n_content < r.n_words / 2 for r in mixed)
    again = qr.fit(docs.repartition(5), labels)
    assert np.array_equal(model.bins, again.bins) and np.array_equal(model.after, again.after)


def test_rules_on_odd_tables(spark, documents, clashing, empty, labelled):
    docs, labels, _ = labelled
    model = qr.fit(docs, labels)
    assert qr.judge(empty, model).collect() == [] and qr.fit(empty, labels) is None
    assert qr.fit(docs, labels.where("quality = 1")) is None and qr.fit(docs, labels.limit(0)) is None
    assert qr.fit(docs, labels.withColumn("quality", F.lit(None).cast("int"))) is None
    plain = sorted(map(tuple, qr.judge(documents, model).collect()))
    assert sorted(map(tuple, qr.judge(clashing, model).collect())) == plain
    twice = labels.union(labels).union(spark.createDataFrame([(None, 1), (None, 0)], "doc_id long, quality int"))
    assert np.array_equal(qr.fit(docs, twice).bins, model.bins)
    rows = spark.createDataFrame([(None, "a b"), (None, None), (1, ""), (1, "")], "doc_id long, text string")
    assert [(r.n_words, r.base_failed, r.kept) for r in qr.judge(rows, model).collect()] == [(2, True, False)] + [(0, True, False)] * 3


def test_rules_on_given_documents(spark):
    """Of the documents that the plain rules pass, good ones stay and bad ones go, labels of a third held out."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    model = qr.fit(docs, labels.where(~out))
    got = qr.judge(docs, model).where("not base_failed").join(labels.where(out), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] >= 0.98 and kept[0] <= 0.2


# -- collocations -------------------------------------------------------------------------


def plain_collocations(rows, longest, least, top, share):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            counts[lang].update(tuple(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        left = []
        for p, a in often.items():
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inside:
                left.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(left)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def phrased():
    rng = random.Random(21)
    words = [f"{c}{i}" for i in range(8) for c in "aé日"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n"]) for _ in range(rng.randrange(0, 60)))
        text += rng.choice(["", " New york City hall", "; of the Same kind as", " a\x0bb\x0cc\rd e f g h"]) + rng.choice(["", "!"])
        rows.append((text, rng.choice(["x", "x", "x", "y", None, "und"])))
    return rows + [(None, "x"), ("", "y"), ("  \t", None), (".,;", "z")] + [rows[0]] * 30


@pytest.mark.parametrize("longest, least, top, share", [(5, 4, 2000, 100), (3, 2, 7, 100), (4, 3, 50, 60), (2, 1, 9, 100)])
def test_collocations_equal_a_plain_count(spark, phrased, longest, least, top, share):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(phrased)], "doc_id long, text string, lang string").repartition(4)
    got = sorted(map(tuple, col.collocations(docs, longest, least, top, share).collect()))
    assert got == plain_collocations(phrased, longest, least, top, share)


def test_a_full_filter_loses_no_phrase(spark, phrased, monkeypatch):
    monkeypatch.setattr(col, "MOST_BITS", 6)
    monkeypatch.setattr(col, "LEAST_BITS", 6)
    docs = spark.createDataFrame(phrased, "text string, lang string")
    assert sorted(map(tuple, col.collocations(docs, 5, 4).collect())) == plain_collocations(phrased, 5, 4, 2000, 100)


def test_collocations_on_odd_tables(spark, documents, corpus, clashing, empty):
    assert col.collocations(empty).collect() == [] and col.collocations(documents, least=10**6).collect() == []
    plain = plain_collocations([(r[1], r[2]) for r in corpus], 5, 8, 2000, 100)
    assert sorted(map(tuple, col.collocations(clashing, least=8).collect())) == plain and plain


def test_scores_past_64_bits(spark):
    rng = random.Random(2)
    f = {p: rng.randrange(10**12, 10**14) for p in ("a", "b", "c", "a b", "b c", "a b c")}
    f = {p: (min(f.values()) - rng.randrange(10**9) * p.count(" ") if " " in p else a) for p, a in f.items()}
    n = 10**15 + 7
    counts = spark.createDataFrame([("x", p, p.count(" ") + 1, a) for p, a in f.items()], "lang string, phrase string, words int, a long")
    got = {r.phrase: (r.l, r.r, r.score) for r in col.scored(counts, spark.createDataFrame([("x", n)], "lang string, n long")).collect()}
    for p in ("a b", "b c", "a b c"):
        w, cuts = p.split(), []
        for k in range(1, len(w)):
            l, r = f[" ".join(w[:k])], f[" ".join(w[k:])]
            cuts.append((1000 * f[p] * n // (l * r), k, l, r))
        assert got[p] == (min(cuts)[2], min(cuts)[3], min(cuts)[0]) and 1000 * f[p] * n > 2**64
