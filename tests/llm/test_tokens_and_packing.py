import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import bpe, packing, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rules():
    return bpe.Bpe(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab eé\n\t\r0 1'sß日!<|endoftext>　  THthe"), max_size=60))
def test_encoder_agrees_with_the_library(text):
    got = [i for part in _encoder().parts(text) for i in part]
    assert got == _library().encode(text, add_special_tokens=False).ids


_held = {}


def _encoder():
    if "e" not in _held:
        _held["e"] = bpe.Encoder(bpe.Bpe(PATH), list)
    return _held["e"]


def _library():
    if "l" not in _held:
        _held["l"] = Tokenizer.from_file(PATH)
    return _held["l"]


def test_proven_strings_are_one_token(rules, library):
    some = list(rules.proven)[::701]
    assert all(library.encode(s, add_special_tokens=False).ids == [rules.proven[s]] for s in some)
    assert 49_000 < len(rules.proven) <= 50_256


@given(st.lists(st.integers(0, 5), max_size=40))
def test_long_merge_is_the_same(ids):
    rank_of = {(0, 1): 0, (6, 2): 1, (1, 1): 2, (3, 3): 3, (9, 9): 4, (2, 0): 5}
    made = [6, 7, 8, 9, 10, 11]
    assert bpe.merge_long(ids[:], rank_of, made) == bpe.merge_ids(ids[:], rank_of, made)


def test_counts(documents, corpus, library, empty, clashing):
    want = {i: ((len((t or "").encode())), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in corpus}
    got = {r.doc_id: r for r in token_counts.count_tokens(clashing, PATH).collect()}
    assert {i: (r.n_bytes, r.n_tokens) for i, r in got.items()} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got.values())
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert token_counts.count_tokens(documents.union(documents), PATH).count() == 2 * len(corpus)


def test_pieces_round_trip(documents, corpus, library, empty):
    rows = packing.pack(packing.pieces_of(documents.union(documents.limit(3)), PATH)).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in corpus}
    seen = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        assert 1 <= r.length <= 2048 and (r.piece == 0 or r.length == 2048)
        seen[r.sequence_id].append((r.offset, r.length))
    total = sum(len(x) for x in ids.values()) + sum(len(ids[r.doc_id]) for r in documents.limit(3).collect())
    assert sum(r.length for r in rows) == total
    for places in seen.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces_of(empty, PATH)).count() == 0


def brute_bins(sizes, capacity):
    """Fewest bins by trying all assignments."""
    best = len(sizes)

    def go(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(sizes):
            best = len(room)
            return
        for i in range(len(room)):
            if room[i] >= sizes[k]:
                room[i] -= sizes[k]
                go(k + 1, room)
                room[i] += sizes[k]
        go(k + 1, [*room, capacity - sizes[k]])

    go(0, [])
    return best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_few_pieces_need_fewest_bins(sizes):
    sizes = sorted(sizes, reverse=True)
    plan = packing.plan_bins(dict(Counter(sizes)), 20)
    assert plan.n_bins == brute_bins(sizes, 20)


def test_many_pieces_come_near_the_bound():
    rng = np.random.default_rng(3)
    sizes = np.minimum(2048, rng.lognormal(6, 1, 5000).astype(int) + 1)
    plan = packing.plan_bins(dict(Counter(sizes.tolist())))
    assert plan.n_bins <= -(-sizes.sum() // 2048) + 1
    placed = Counter()
    for length, first, end, *_ in plan.rows:
        placed[length] += end - first
    assert placed == Counter(sizes.tolist())


def test_repeated_fillings_and_full_pieces():
    plan = packing.plan_bins({2048: 1000, 1024: 4000, 1: 1})
    assert plan.n_bins == 1000 + 2000 + 1


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (2048, [(0, 2048)]), (2049, [(0, 1), (1, 2048)]), (4096, [(0, 2048), (2048, 2048)])])
def test_cut(n, want):
    assert packing.cut(n, 2048) == want


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([(560, 900), (1, 2049), (300, 1100), (700, 1030), (30, 700)]), st.integers(1, 400))
def test_never_more_than_plain_best_fit(seed, span, n):
    sizes = np.random.default_rng(seed).integers(*span, n).tolist()
    counts = [0] * 2049
    for x in sizes:
        counts[x] += 1
    plain, grouped = packing.best_fit(sizes, 2048), packing.best_fit_patterns(counts, 2048)
    #: bins of equal room may change places
    assert sorted(sum(b) for b in plain) == sorted(sum(f) for f, m in grouped for _ in range(m))
    few = packing.few_bins(counts, 2048)
    assert Counter(x for f, m in few for _ in range(m) for x in f) == Counter(sizes) and all(sum(f) <= 2048 for f, _ in few)
    assert -(-sum(sizes) // 2048) <= packing.bins_of(few) <= len(plain)


def test_twenty_histograms_against_plain_best_fit():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(*[(560, 900), (400, 1400), (1, 2049), (650, 1030)][seed % 4], 3000)
        plan = packing.plan_bins(dict(Counter(sizes.tolist())))
        counts = np.bincount(sizes, minlength=2049).tolist()
        assert plan.n_bins <= packing.bins_of(packing.best_fit_patterns(counts, 2048))
