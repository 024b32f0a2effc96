"""Vectorised scanning of text columns: Arrow string buffers to word hashes without a Python object per word."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of array operations takes; its temporaries are some fifty times as large.
CHUNK = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MULT = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    m = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        m[lo : hi + 1] = True
    return m


#: Everything but blanks: ``[^\x20\x09-\x0D]+``.
NON_SPACE = ~_mask((0x20, 0x20), (0x09, 0x0D))
#: ASCII letters and digits and every byte of a non-ASCII character: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing.
ALNUM = ~_mask((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Visible ASCII signs; runs of these are words of their own where punctuation counts.
SIGNS = _mask((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_pow = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """MULT to the powers 0..n-1, modulo 2**64."""
    global _pow
    if len(_pow) < n:
        x = np.full(max(n, 1024), MULT, dtype=np.uint64)
        x[0] = 1
        _pow = np.cumprod(x, dtype=np.uint64)
    return _pow[:n]


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages, beside an executor's heap."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def text_chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about `limit` bytes.  Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=kind)[col.offset : col.offset + n + 1].astype(np.int64) if off is not None and off.size else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:  # a null's span is empty by the format, but only by convention
        lens = np.diff(offs) * np.asarray(col.is_valid())
        if lens.sum() != offs[-1] - offs[0]:
            keep = np.repeat(np.asarray(col.is_valid()), np.diff(offs))
            raw = raw[offs[0] : offs[-1]][keep]
            offs = np.concatenate([[0], np.cumsum(lens)])
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n, i + 60_000)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j
    give_back()


def _spans(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = kind[raw]
    if not len(m):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.empty(len(m), dtype=bool)
    edge[0] = False
    edge[1:] = m[:-1]
    inner = offs[:-1][offs[:-1] < len(m)]
    edge[inner] = False
    starts = np.flatnonzero(m & ~edge)
    edge[-1] = False
    edge[:-1] = m[1:]
    edge[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(m & ~edge) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 512
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of `raw` on, zeros behind its end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: lanes of eight bytes go one after the other through a non-linear finaliser."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    lane = _lanes(raw)
    out = mix(lens.astype(np.uint64) * MULT)
    out = mix(out ^ (lane[starts] & _TAIL[np.minimum(lens, 8)]))
    left = np.flatnonzero((lens > 8) & (lens <= LONG_SPAN))
    i = 8
    while len(left):
        out[left] = mix(out[left] * MULT ^ (lane[starts[left] + i] & _TAIL[np.minimum(lens[left] - i, 8)]))
        i += 8
        left = left[lens[left] > i]
    for j in np.flatnonzero(lens > LONG_SPAN):
        out[j] = int.from_bytes(hashlib.blake2b(raw[starts[j] : ends[j]].data, digest_size=8).digest(), "little")
    return out


def same_spans(raw: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span [a, a_end) are those of [b, b_end)."""
    ok = a_end - a == b_end - b
    lane, lens = _lanes(raw), a_end - a
    left, i = np.flatnonzero(ok & (a != b)), 0
    while len(left):
        mask = _TAIL[np.minimum(lens[left] - i, 8)]
        ok[left] &= (lane[a[left] + i] & mask) == (lane[b[left] + i] & mask)
        i += 8
        left = left[ok[left] & (lens[left] > i)]
    return ok


def pieces(raw: np.ndarray, kind: np.ndarray, limit: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """[start, end) of stretches of about `limit` bytes that end behind a byte that is not of `kind`, or where a run ends at last."""
    at = 0
    while at < len(raw):
        end = min(at + limit, len(raw))
        while end < len(raw):
            back = np.flatnonzero(~kind[raw[end - 1 : min(end + limit, len(raw))]])
            if len(back):
                end += int(back[0])
                break
            end = min(end + limit, len(raw))
        yield at, end
        at = end


def spans(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes of `kind`; runs never cross documents."""
    if len(raw) <= 2 * CHUNK:
        return _spans(raw, offs, kind)
    out = []
    for a, b in pieces(raw, kind):
        i, j = np.searchsorted(offs, [a, b])
        s, e, _ = _spans(raw[a:b], np.concatenate([[0], offs[i:j] - a, [b - a]]), kind)
        out.append((s + a, e + a))
    starts, ends = (np.concatenate(c) for c in zip(*out, strict=True))
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def word_hashes(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word, A-Z lower-cased or as it stands; a very long text is worked through in stretches."""
    if len(raw) <= 2 * CHUNK:
        low = LOWER[raw] if lower else raw
        starts, ends, doc = _spans(low, offs, kind)
        return span_hashes(low, starts, ends), doc
    hashes, docs = [], []
    for a, b in pieces(raw, kind[LOWER] if lower else kind):
        low = LOWER[raw[a:b]] if lower else raw[a:b]
        i, j = np.searchsorted(offs, [a, b])
        starts, ends, doc = _spans(low, np.concatenate([[0], offs[i:j] - a, [b - a]]), kind)
        hashes.append(span_hashes(low, starts, ends))
        docs.append((doc + (i - 1)).astype(np.int32))
    return np.concatenate(hashes), np.concatenate(docs)


#: Entries of `window_hashes` that are worked on at once.
WINDOWS = 1 << 18


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * MULT + b)


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    out, done, size, power = None, 0, 1, h
    while True:  # `power` has the hashes of `size` consecutive entries; the binary digits of k say which are joined
        if k & size:
            part = power[done : done + n]
            out = part if out is None else _join(out, part)
            done += size
        if done == k:
            return mix(out + U(k))
        power, size = _join(power[:-size], power[size:]), 2 * size


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of `h` (len(h) - k + 1 of them), across document borders too."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if n <= WINDOWS:
        return _windows(h, k)
    out = np.empty(n, np.uint64)
    for a in range(0, n, WINDOWS):
        out[a : a + WINDOWS] = _windows(h[a : a + WINDOWS + k - 1], k)
    return out


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document as 64-bit hashes, ascending within each document, and the documents.

    With fewer words than k the whole sequence is the one shingle; without words there is none.
    """
    h, doc = word_hashes(raw, offs, NON_SPACE)
    per = np.bincount(doc, minlength=len(offs) - 1)
    short = np.flatnonzero((per > 0) & (per < k))
    extra = np.zeros(len(short), np.uint64)
    if len(short):
        first = np.cumsum(per) - per
        for i in range(k - 1):
            has = per[short] > i
            extra[has] = _join(extra[has], h[first[short][has] + i])
        extra = mix(extra + per[short].astype(np.uint64) * U(0xD6E8FEB86659FD93))
    vals = window_hashes(h, k)
    del h
    if len(vals):
        ok = doc[: len(vals)] == doc[k - 1 :]
        if not ok.all():
            vals = vals[ok]
    del doc
    n = np.maximum(per - k + 1, 0)
    n[short] = 1
    ends = np.cumsum(n)
    if len(short):
        vals = np.insert(vals, (ends - n)[short] - np.arange(len(short)), extra)
    for d in np.flatnonzero(n > 1):
        vals[ends[d] - n[d] : ends[d]].sort()
    new = np.ones(len(vals), bool)
    new[1:] = vals[1:] != vals[:-1]
    new[(ends - n)[n > 0]] = True
    docs = np.repeat(np.arange(len(n), dtype=np.int64), n)
    return (vals, docs) if new.all() else (vals[new], docs[new])


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
