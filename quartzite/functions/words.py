"""Words as two-byte tokens: a byte codec for texts, with its inverse.

A run of ASCII letters whose lower-case form is in the vocabulary becomes two bytes: 0x80 plus the high bits, then the low ones, of a
number of 13 bits for the word and two for its case (lower, upper, title).  Bytes from 0x80 on get 0xFF in front.  All others stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np

#: Words that a vocabulary holds at most, and the shortest word that a token saves on.
MAX_WORDS, MIN_LETTERS = 8192, 3
_PART = re.compile(rb"[a-zA-Z]+|[\x80-\xff]|[^a-zA-Z\x80-\xff]+")
_TOKEN = re.compile(rb"[\x80-\xff].?|[\x00-\x7f]+", re.DOTALL)
_WORD = re.compile(rb"[a-zA-Z]{3,}")
_RUN = re.compile(rb"[a-zA-Z]+|[^a-zA-Z]+")
_LETTERS, _NAME = re.compile(rb"[a-zA-Z]+"), re.compile(rb"[a-zA-Z_][a-zA-Z0-9_]*")
_LETTERS_END, _NAME_END = re.compile(rb"[a-zA-Z][^a-zA-Z]"), re.compile(rb"[a-zA-Z0-9_][^a-zA-Z0-9_]")
_IS_LETTER = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
#: Bytes of a long text that are split at once.
STRETCH = 4 << 20


def _stretches(x: bytes, end: re.Pattern, size: int = STRETCH) -> Iterator[bytes]:
    """`x` in pieces of `size` bytes or more, cut only behind a word."""
    at = 0
    while len(x) - at > size and (m := end.search(x, at + size - 1)):
        yield x[at : m.start() + 1]
        at = m.start() + 1
    if at < len(x):
        yield x[at:]


def codes(vocabulary: Sequence[bytes]) -> dict[bytes, int]:
    """Case (0 lower, 1 upper, 2 title) times MAX_WORDS and number of the word, for each form that is a token."""
    out: dict[bytes, int] = {}
    for case, form in enumerate((bytes, bytes.upper, bytes.capitalize)):
        for i, w in enumerate(vocabulary):
            out.setdefault(form(w), case * MAX_WORDS + i)
    return out


def counts(x: bytes, code: dict[bytes, int]) -> dict[bytes, int]:
    """How often each known form stands in `x`."""
    n: Counter = Counter()
    for y in _stretches(x, _LETTERS_END):
        n.update(_LETTERS.findall(y))
    return {w: c for w, c in n.items() if w in code}


def sizes(x: bytes, code: dict[bytes, int]) -> tuple[int, int, int]:
    """(parts, tokens, bytes): a token has two bytes, a literal byte outside ASCII an escape byte before it."""
    if not x:
        return 0, 0, 0
    raw = np.frombuffer(x, np.uint8)
    letter, n = _IS_LETTER[raw], counts(x, code)
    return 1 + int(np.count_nonzero(letter[1:] != letter[:-1])), sum(n.values()), len(x) + int(np.count_nonzero(raw >= 0x80)) - sum((len(w) - 2) * c for w, c in n.items())


def split(x: bytes, code: dict[bytes, int]) -> tuple[bytes, bytes]:
    """(ids, literals): 32-bit numbers, a code for each known word and else -n for n bytes of `literals`."""
    ids, literals = [], []
    for y in _stretches(x, _LETTERS_END):
        parts = _RUN.findall(y)
        ids.append(np.array([code.get(w, -len(w)) for w in parts], "<i4").tobytes())
        literals += [b"".join([w for w in parts if w not in code])]
    return b"".join(ids), b"".join(literals)


def joined(ids: bytes, literals: bytes, form: Sequence[bytes]) -> bytes:
    """The inverse of `split`; `form` has the words by code."""
    out, at, every = [], 0, np.frombuffer(ids, "<i4")
    for i in range(0, len(every), 1 << 20):
        part = []
        for k in every[i : i + (1 << 20)].tolist():
            if k < 0:
                part.append(literals[at : at - k])
                at -= k
            else:
                part.append(form[k])
        out.append(b"".join(part))
    return b"".join(out)


def names(x: bytes) -> tuple[Counter, dict[bytes, int]]:
    """How often each identifier stands in `x`, in order of first appearance, and the number of that one among all."""
    n: Counter = Counter()
    first: dict[bytes, int] = {}
    for y in _stretches(x, _NAME_END):
        found, done = _NAME.findall(y), n.total()
        own = dict(zip(reversed(found), range(done + len(found) - 1, done - 1, -1), strict=True))
        n.update(found)
        first = own | first
    return n, first


def learn(texts: Sequence[bytes], limit: int = MAX_WORDS) -> list[bytes]:
    """The words that save most: lower case, by bytes saved, then by the word."""
    n: Counter = Counter()
    for x in texts:
        n.update(_WORD.findall(x))
    low: Counter = Counter()
    for w, c in n.items():
        low[w.lower()] += c
    saved = [((len(w) - 2) * c - len(w) - 1, w) for w, c in low.items()]
    return [w for s, w in sorted(((s, w) for s, w in saved if s > 0), key=lambda p: (-p[0], p[1]))[:limit]]


def forms(vocabulary: Sequence[bytes]) -> dict[bytes, bytes]:
    """What each part that changes becomes."""
    out = {bytes([b]): bytes([0xFF, b]) for b in range(0x80, 0x100)}
    for case, form in enumerate((bytes, bytes.upper, bytes.capitalize)):
        for i, w in enumerate(vocabulary):
            token = case << 13 | i
            out.setdefault(form(w), bytes([0x80 | token >> 8, token & 255]))
    return out


#: Bytes of a text whose parts are held at once.
PIECE = 1 << 20


def _replaced(x: bytes, part: re.Pattern, table: dict[bytes, bytes]) -> bytes:
    """`x` with the parts of `table` replaced, a piece at a time."""
    out, at = [], 0
    while at < len(x):
        end = min(len(x), at + PIECE)
        parts = part.findall(x, at, end)
        if end < len(x):  # the last may go on
            end -= len(parts.pop())
            if not parts:
                end = part.match(x, at).end()
                parts = [x[at:end]]
        out.append(b"".join(map(table.get, parts, parts)))
        at = end
    return b"".join(out)


def encode(x: bytes, table: dict[bytes, bytes]) -> bytes:
    """`x` with the parts of `table` (see `forms`) replaced."""
    return _replaced(x, _PART, table)


def inverse(vocabulary: Sequence[bytes]) -> dict[bytes, bytes]:
    """What each token of this vocabulary stands for."""
    out = {bytes([0xFF, b]): bytes([b]) for b in range(256)}
    for case, form in enumerate((bytes, bytes.upper, bytes.capitalize)):
        for i, w in enumerate(vocabulary):
            token = case << 13 | i
            if i < MAX_WORDS:
                out[bytes([0x80 | token >> 8, token & 255])] = form(w)
    return out


def decode(y: bytes, vocabulary: Sequence[bytes] | dict[bytes, bytes]) -> bytes:
    """The inverse, by a vocabulary or its `inverse`; what is no token of it stays."""
    return _replaced(y, _TOKEN, vocabulary if isinstance(vocabulary, dict) else inverse(vocabulary))
