"""Words and word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(90_210)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
#: Bytes that separate words, and A-Z lowered.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LETTER_LOWER = _LETTER[LOWER]
#: For hashes that tell A-Z from a-z.
CASED = _LETTER
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_spans(raw: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of every word of texts laid end to end; ``apart`` tells which bytes separate words."""
    n = len(raw)
    word = np.zeros(n + 1, bool)
    np.logical_not(apart[raw], out=word[:n])
    first = word[:n].copy()
    first[1:] &= ~word[: n - 1]
    edges = offsets[offsets < n]
    first[edges] = word[edges]
    last = word[:n] & ~word[1:]
    inner = edges[edges > 0] - 1
    last[inner] = word[inner]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = _LETTER_LOWER) -> np.ndarray:
    """A hash of each span of bytes; A-Z are lowered unless ``letters`` is CASED."""
    up, down = _power(max(len(raw), 1))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * up[: len(raw)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each document) for texts laid end to end.

    A word is a run of bytes other than space and 0x09-0x0D; A-Z are lowered.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = word_spans(raw, offsets)
    return span_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words; with fewer words, one for the whole sequence; none for none."""
    n = len(words)
    if n == 0:
        return words
    m = min(n, width)
    out = np.full(n - m + 1, np.uint64(m), np.uint64)
    for k in range(m):
        out = (out * np.uint64(0xD6E8FEB86659FD93)) + words[k : n - m + 1 + k]
        out ^= out >> np.uint64(32)
    return mixed(out)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(words, width))
