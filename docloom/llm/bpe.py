"""Byte-level BPE with a whole-token shortcut.

The tokenizer file is read once on the driver.  Every vocabulary string is
pushed through the merge loop there; those that come out as one single token
are *proven*: a pre-token equal to such a string is one token, and no merge
has to be run for it.  Only the other pre-tokens are merged.

A text is cut before every space that a non-space character follows.  The
pre-token pattern never matches across such a cut, and what it matches
inside a part does not depend on the neighbouring parts, so each part can be
encoded alone and its result kept in a bounded memo.
"""

from __future__ import annotations

import heapq
import json
import re

import regex

# The pre-token pattern of byte-level BPE vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Entries that the memo of one worker may hold; it is emptied when full.
MEMO_ENTRIES = 300_000
#: Longest part that is remembered.
MEMO_CHARS = 64


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files.

    Visible Latin-1 characters stand for themselves; the other bytes take the
    code points from 256 on, in order.
    """
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in visible}
    hidden = (b for b in range(256) if b not in table)
    table.update({b: chr(256 + i) for i, b in enumerate(hidden)})
    return table


NONE = 1 << 60


def merge_ids(ids: list[int], rank_of: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left.

    ``rank_of`` ranks pairs of ids, ``made[rank]`` is the id that the pair becomes.
    """
    get = rank_of.get
    ranks = [get(p, NONE) for p in zip(ids, ids[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        ids[i : i + 2] = (made[low],)
        del ranks[i]
        if i < len(ranks):
            ranks[i] = get((ids[i], ids[i + 1]), NONE)
        if i:
            ranks[i - 1] = get((ids[i - 1], ids[i]), NONE)
    return ids


def merge_long(ids: list[int], rank_of: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """The same result as :func:`merge_ids` in O(n log n), for long pre-tokens."""
    n = len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j < n and (rank := rank_of.get((ids[i], ids[j]))) is not None:
            heapq.heappush(heap, (rank, i, ids[i], ids[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        rank, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j] = made[rank], False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return [x for x, keep in zip(ids, alive) if keep]


class Bpe:
    """Rules read from a ``.json`` tokenizer file; small enough to broadcast (a few MB)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["model"]["type"], (spec["pre_tokenizer"] or {}).get("type")
        if kind != ("BPE", "ByteLevel") or spec["normalizer"] or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.rank_of, self.made = {}, []
        for rank, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.rank_of[vocab[left], vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options are not supported")
        self.proven = self.prove(vocab, {c: b for b, c in letters.items()})

    def merge(self, raw: bytes) -> list[int]:
        ids = list(map(self.of_byte.__getitem__, raw))
        return (merge_ids if len(ids) < 200 else merge_long)(ids, self.rank_of, self.made)

    def prove(self, vocab: dict[str, int], byte_of: dict[str, int]) -> dict[str, int]:
        """Vocabulary strings that are one pre-token and that merging leaves as one token."""
        whole = regex.compile(PRETOKEN)
        out = {}
        for s, i in vocab.items():
            try:
                raw = bytes(map(byte_of.__getitem__, s))
                text = raw.decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if whole.fullmatch(text) and self.merge(raw) == [i]:
                out[text] = i
        return out


class Encoder:
    """Encodes texts in one worker; ``make(ids)`` is what is remembered of a part."""

    def __init__(self, rules: Bpe, make):
        self.rules, self.make = rules, make
        self.pretoken = regex.compile(PRETOKEN)
        #: a space that no visible character follows; such texts are cut by the pattern only
        self.odd_space = re.compile(r" (?=\s|\Z)")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(rules.special, key=len, reverse=True))) + ")") if rules.special else None
        self.memo = Memo(self)

    def ids(self, text: str) -> list[int]:
        """Ids of a text without special strings."""
        out: list[int] = []
        proven, merge = self.rules.proven, self.rules.merge
        for p in self.pretoken.findall(text):
            one = proven.get(p)
            if one is None:
                out += merge(p.encode("utf-8", "replace"))
            else:
                out.append(one)
        return out

    def parts(self, text: str) -> list:
        """What ``make`` gives for the parts of the text, in order."""
        if not text:
            return []
        if self.special and self.special.search(text):
            out = []
            for s in self.special.split(text):
                if s in self.rules.special:
                    out.append(self.make([self.rules.special[s]]))
                else:
                    out += self.plain(s)
            return out
        return self.plain(text)

    def plain(self, text: str) -> list:
        if not text:
            return []
        if self.odd_space.search(text):
            #: cut in front of the last space of each run only
            pieces = re.split(r" (?=\S)", text)
        else:
            pieces = text.split(" ")
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        first = [self.make(self.ids(pieces[0]))] if pieces[0] else []
        return first + list(map(memo.__getitem__, pieces[1:]))


class Memo(dict):
    """Part without its leading space -> what ``make`` gives for it."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, part: str):
        got = self.owner.make(self.owner.ids(" " + part))
        if len(part) <= MEMO_CHARS:
            self[part] = got
        return got
