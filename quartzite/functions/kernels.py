"""Byte transforms on numpy arrays of uint8, each with its inverse, and the checksum that Spark lacks.

They run inside Arrow batches, one call a row: a document's bytes never become rows, so none of them shuffles.
"""

from __future__ import annotations

import numpy as np

from quartzite.functions.columns import mask_bits

U8 = np.uint8


def as_bytes(x: bytes | None) -> np.ndarray:
    return np.frombuffer(x or b"", U8)


# --- differences ---------------------------------------------------------------------------------------------------


def delta(x: np.ndarray) -> np.ndarray:
    """Each byte less the one before, modulo 256."""
    return np.diff(x, prepend=U8(0)) if len(x) else x


def undelta(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=U8)


def xor_blocks(x: np.ndarray, size: int = 64) -> np.ndarray:
    """Each byte XOR the one before it in its block of `size`; a tail shorter than a block stays."""
    n = len(x) // size * size
    out = x.copy()
    head = x[:n].reshape(-1, size)
    out[:n].reshape(-1, size)[:, 1:] = head[:, 1:] ^ head[:, :-1]
    return out


def unxor_blocks(x: np.ndarray, size: int = 64) -> np.ndarray:
    n = len(x) // size * size
    out = x.copy()
    out[:n] = np.bitwise_xor.accumulate(x[:n].reshape(-1, size), axis=1).ravel()
    return out


# --- blocks --------------------------------------------------------------------------------------------------------


def cut_blocks(x: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """`x` without the blocks of `size` bytes at `places`; the last block may be shorter."""
    whole = len(x) // size
    keep = np.ones(-(-len(x) // size), bool)
    keep[places] = False
    tail = x[whole * size :] if keep[whole:].all() else x[:0]
    return np.concatenate([x[: whole * size].reshape(-1, size)[keep[:whole]].ravel(), tail])


def fill_blocks(x: np.ndarray, places: np.ndarray, blocks: np.ndarray, size: int) -> np.ndarray:
    """The inverse of `cut_blocks`, from the cut blocks' bytes by place."""
    out = np.empty(len(x) + len(blocks), U8)
    whole = len(out) // size
    keep = np.ones(-(-len(out) // size), bool)
    keep[places] = False
    body, n = out[: whole * size].reshape(-1, size), int(keep[:whole].sum()) * size
    body[keep[:whole]] = x[:n].reshape(-1, size)
    body[~keep[:whole]] = blocks[: whole * size - n].reshape(-1, size)
    out[whole * size :] = x[n:] if keep[whole:].all() else blocks[whole * size - n :]
    return out


# --- planes --------------------------------------------------------------------------------------------------------


def to_planes(x: np.ndarray, elem: int, reverse: bool = True) -> tuple[np.ndarray, int]:
    """Bytes of an n x elem matrix by column, the last column first if `reverse`; zero-padded.  Returns the pad's length, too."""
    pad = -len(x) % elem
    m = np.concatenate([x, np.zeros(pad, U8)]).reshape(-1, elem)
    return (m[:, ::-1] if reverse else m).T.ravel(), pad


def from_planes(x: np.ndarray, elem: int, pad: int, reverse: bool = True) -> np.ndarray:
    m = x.reshape(elem, -1).T
    out = (m[:, ::-1] if reverse else m).ravel()
    return out[: len(out) - pad]


def shuffle(x: np.ndarray, elem: int, with_delta: bool) -> tuple[np.ndarray, int]:
    """Planes, the highest byte first, each plane as differences where that was asked for, elem is 2 at least and a plane has 4 bytes."""
    planes, pad = to_planes(x, elem)
    if with_delta and elem >= 2 and len(planes) >= 4 * elem:
        planes = np.concatenate([delta(p) for p in planes.reshape(elem, -1)])
    return planes, pad


def unshuffle(x: np.ndarray, elem: int, pad: int, with_delta: bool) -> np.ndarray:
    if with_delta and elem >= 2 and len(x) >= 4 * elem:
        x = np.concatenate([undelta(p) for p in x.reshape(elem, -1)])
    return from_planes(x, elem, pad)


def bit_planes(x: np.ndarray) -> np.ndarray:
    """Blocks of 64 bytes as eight planes of 64 bits (bit k of all bytes, the first byte's the lowest), each plane's bytes XOR the one before; a tail stays."""
    n = len(x) // 64 * 64
    bits = np.unpackbits(x[:n].reshape(-1, 64, 1), axis=2, bitorder="little").transpose(0, 2, 1)
    planes = np.packbits(bits, axis=2, bitorder="little")
    planes[:, :, 1:] ^= planes[:, :, :-1].copy()
    return np.concatenate([planes.ravel(), x[n:]])


def unbit_planes(x: np.ndarray) -> np.ndarray:
    n = len(x) // 64 * 64
    planes = np.bitwise_xor.accumulate(x[:n].reshape(-1, 8, 8), axis=2)
    bits = np.unpackbits(planes, axis=2, bitorder="little").transpose(0, 2, 1)
    return np.concatenate([np.packbits(bits, axis=2, bitorder="little").ravel(), x[n:]])


def byte_swap(x: np.ndarray) -> np.ndarray:
    """Groups of four bytes in reverse; a tail stays.  Its own inverse."""
    n = len(x) // 4 * 4
    return np.concatenate([x[:n].reshape(-1, 4)[:, ::-1].ravel(), x[n:]])


def ordinal(x: np.ndarray) -> np.ndarray:
    """Little-endian floats as signed numbers in their order: a negative one is minus its magnitude bits; a tail stays.

    Both zeros become 0, so minus zero comes back as zero; all other bits come back by `unordinal`.
    """
    n = len(x) // 4 * 4
    u = x[:n].view("<u4")
    return np.concatenate([np.where(u >> 31 == 1, np.uint32(0x80000000) - u, u).astype("<u4").view(U8), x[n:]])


def unordinal(x: np.ndarray) -> np.ndarray:
    return ordinal(x)


# --- masks ----------------------------------------------------------------------------------------------------------


def mask_pcm(x: np.ndarray, level: int, header: int = 44) -> np.ndarray:
    """16-bit samples after a header: the low byte loses four bits, or all of them from level 2 on."""
    out = x.copy()
    out[header::2] &= 0xF0 if level == 1 else 0
    return out


def mask_pixels(x: np.ndarray, level: int, header: int = 54) -> np.ndarray:
    out = x.copy()
    out[header:] &= 0xF8 if level == 1 else 0xF0
    return out


def mask_floats(x: np.ndarray, level: int) -> np.ndarray:
    """Little-endian floats with their low bits cleared; a tail shorter than a float stays."""
    n = len(x) // 4 * 4
    bits = x[:n].view("<u4") & np.uint32(0xFFFFFFFF << mask_bits(level) & 0xFFFFFFFF)
    return np.concatenate([bits.view(np.uint8), x[n:]])



# --- runs ----------------------------------------------------------------------------------------------------------


def runs(x: np.ndarray, cap: int = 255) -> tuple[np.ndarray, np.ndarray]:
    """(byte, length) of the maximal runs, cut at `cap`."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    n = np.diff(np.append(at, len(x)))
    parts = -(-n // cap)
    value = np.repeat(x[at], parts)
    length = np.full(len(value), cap)
    length[np.cumsum(parts) - 1] = n - (parts - 1) * cap
    return value, length


def _emit(pieces: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(pieces).astype(U8) if pieces else np.zeros(0, U8)


def rle_zero(x: np.ndarray) -> np.ndarray:
    """Runs of zero become a zero and their length up to 255; other bytes stay."""
    v, n = runs(x)
    size = np.where(v == 0, 2, n)
    out = np.repeat(v, size)
    out[(np.cumsum(size) - size)[v == 0] + 1] = n[v == 0]
    return out


def unrle_zero(x: np.ndarray) -> np.ndarray:
    out, i = [], 0
    zeros = np.flatnonzero(x == 0)
    while True:  # only zeros that start a pair matter; a count is never zero
        k = np.searchsorted(zeros, i)
        if k == len(zeros):
            out.append(x[i:])
            return _emit(out)
        z = zeros[k]
        out += [x[i:z], np.zeros(int(x[z + 1]), U8)]
        i = z + 2


def rle(x: np.ndarray) -> np.ndarray:
    """Runs of four or more become zero, length, byte; a zero in a shorter run becomes zero, one, zero."""
    v, n = runs(x)
    long = n >= 4
    zero = (v == 0) & ~long
    size = np.where(long, 3, np.where(zero, 3 * n, n))
    out = np.repeat(v, size)
    first = np.cumsum(size) - size
    out[first[long]], out[first[long] + 1], out[first[long] + 2] = 0, n[long], v[long]
    for k in range(3):
        at = first[zero & (n > k)] + 3 * k
        out[at], out[at + 1], out[at + 2] = 0, 1, 0
    return out


def unrle(x: np.ndarray) -> np.ndarray:
    out, i = [], 0
    zeros = np.flatnonzero(x == 0)
    while True:
        k = np.searchsorted(zeros, i)
        if k == len(zeros):
            out.append(x[i:])
            return _emit(out)
        z = zeros[k]
        out += [x[i:z], np.full(int(x[z + 1]), x[z + 2], U8)]
        i = z + 3


# --- sorting transforms --------------------------------------------------------------------------------------------


def bwt(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Last column of the sorted cyclic rotations (ties by place), and the rank of the text itself; by prefix doubling."""
    n = len(x)
    if not n:
        return x, 0
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < n:
        key = rank * (n + 1) + np.roll(rank, -k)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return x[(order - 1) % n], int(np.flatnonzero(order == 0)[0])


def unbwt(last: np.ndarray, primary: int) -> np.ndarray:
    n = len(last)
    if not n:
        return last
    nxt = np.argsort(last, kind="stable")  # row of the rotation that starts one further
    out = np.empty(n, U8)
    # follow by doubling: rows of 1, 2, 4 ... steps at once
    rows = np.array([primary])
    step = nxt
    while len(rows) < n:
        rows = np.concatenate([rows, step[rows]])
        step = step[step]
    out[:] = np.sort(last)[rows[:n]]
    return out


def mtf(x: np.ndarray) -> np.ndarray:
    """Place of each byte in a list from which it moves to the front."""
    table, out = list(range(256)), np.empty(len(x), U8)
    for i, b in enumerate(x.tolist()):
        k = table.index(b)
        out[i] = k
        if k:
            table.insert(0, table.pop(k))
    return out


def unmtf(x: np.ndarray) -> np.ndarray:
    table, out = list(range(256)), np.empty(len(x), U8)
    for i, k in enumerate(x.tolist()):
        b = table.pop(k)
        out[i] = b
        table.insert(0, b)
    return out


# --- CRC-32C -------------------------------------------------------------------------------------------------------

_LANE = 128


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t.astype(np.uint32)


_CRC = _table()


def _zeros_after(c: np.ndarray, n: int) -> np.ndarray:
    for _ in range(n):
        c = (c >> 8) ^ _CRC[c & 0xFF]
    return c


#: What 2**k lanes of zeros make of each byte of the register, by k: the register is linear, so four lookups move it on.
_AHEAD = [np.stack([_zeros_after(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), _LANE) for k in range(4)])]


def _moved(c: np.ndarray, k: int) -> np.ndarray:
    while len(_AHEAD) <= k:
        t = _AHEAD[-1]
        _AHEAD.append(np.stack([_through(t, t[i]) for i in range(4)]))
    return _through(_AHEAD[k], c)


def _through(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 0xFF] ^ t[1][c >> 8 & 0xFF] ^ t[2][c >> 16 & 0xFF] ^ t[3][c >> 24]


def crc32c_rows(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """CRC-32C (Castagnoli) of each row: lanes of 128 bytes of all rows side by side, each moved to its row's end, then joined."""
    n = np.diff(offs)
    out = np.zeros(len(n), np.uint32)
    for i in np.flatnonzero((n > 0) & (n < 4)).tolist():
        c = 0xFFFFFFFF
        for b in x[offs[i] : offs[i + 1]].tolist():
            c = c >> 8 ^ int(_CRC[(c ^ b) & 0xFF])
        out[i] = c ^ 0xFFFFFFFF
    rows = np.flatnonzero(n >= 4)
    if not len(rows):
        return out
    per = -(-n[rows] // _LANE)
    first = np.cumsum(per) - per
    pad = per * _LANE - n[rows]  # zeros in front change nothing
    lanes = np.zeros(int(per.sum()) * _LANE, U8)
    start = first * _LANE + pad
    if len(rows) == len(n) and not pad.any():
        lanes[:] = x
    else:
        for s, a, m in zip(start.tolist(), offs[rows].tolist(), n[rows].tolist(), strict=True):
            lanes[s : s + m] = x[a : a + m]
    for k in range(4):
        lanes[start + k] ^= U8(0xFF)
    lanes = np.ascontiguousarray(lanes.reshape(-1, _LANE).T)
    c = np.zeros(lanes.shape[1], np.uint32)
    for lane in lanes:
        c = (c >> np.uint32(8)) ^ _CRC[(c ^ lane) & np.uint32(0xFF)]
    left = np.repeat(per, per) - 1 - (np.arange(len(c)) - np.repeat(first, per))  # lanes behind this one in its row
    k = 0
    while (left >> k).any():
        some = np.flatnonzero(left >> k & 1)
        c[some] = _moved(c[some], k)
        k += 1
    out[rows] = np.bitwise_xor.reduceat(c, first) ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(x: np.ndarray) -> int:
    """CRC-32C of one byte string."""
    return int(crc32c_rows(x, np.array([0, len(x)]))[0])


# --- numbers -------------------------------------------------------------------------------------------------------


def entropy(counts: np.ndarray) -> float:
    """Bits a symbol; 0 for nothing."""
    c = counts[counts > 0].astype(np.float64)
    n = c.sum()
    return float(-(c / n * np.log2(c / n)).sum()) if len(c) else 0.0


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it)."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7
