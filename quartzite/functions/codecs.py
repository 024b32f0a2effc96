"""Codecs on byte strings: library compressors, block and sorting codecs, and adaptive arithmetic coders."""

from __future__ import annotations

import bz2
import gzip
import lzma
import math
import struct
import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from quartzite.functions import kernels as K

try:
    import zstandard
except ImportError:
    zstandard = None
try:
    import brotli
except ImportError:
    brotli = None


@lru_cache(maxsize=16)
def zstd(level: int, dictionary: bytes | None = None):
    """(compress, decompress), kept for each Python worker."""
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if d:
        d.precompute_compress(level=level)
    made: dict = {}  # on first use, as they can't be pickled

    def compress(x: bytes) -> bytes:
        if "c" not in made:
            made["c"] = zstandard.ZstdCompressor(level=level, dict_data=d)
        return made["c"].compress(x)

    def decompress(y: bytes) -> bytes:
        if "d" not in made:
            made["d"] = zstandard.ZstdDecompressor(dict_data=d)
        return made["d"].decompress(y)

    return compress, decompress


#: name -> (compress, decompress), by what is installed.
LIBRARY: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "zlib6": (lambda x: zlib.compress(x, 6), zlib.decompress), "gzip9": (lambda x: gzip.compress(x, 9, mtime=0), gzip.decompress),
    "bzip2": (lambda x: bz2.compress(x, 9), bz2.decompress), "lzma9": (lambda x: lzma.compress(x, preset=9), lzma.decompress),
}
if zstandard:
    LIBRARY |= {f"zstd{level}": zstd(level) for level in (1, 3, 9, 12, 15, 19, 22)}
if brotli:
    LIBRARY |= {f"brotli{q}": ((lambda x, q=q: brotli.compress(x, quality=q)), brotli.decompress) for q in (4, 7, 9, 10, 11)}


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstd dictionary from a bounded sample; empty where the library finds too little."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if zstandard and len(samples) >= 4 else b""
    except zstandard.ZstdError:
        return b""


# --- layouts and block codec ---------------------------------------------------------------------------------------

RAW, DEFLATED, PLANAR, RUNS = 0, 1, 3, 4


def pack_block(x: bytes, level: int = 6) -> tuple[int, bytes]:
    """(mode, payload): the smallest of raw, deflated, deflated planes of four, deflated runs; of equals the first."""
    a = K.as_bytes(x)
    planes, pad = K.to_planes(a, 4, reverse=False)
    best = (RAW, x)
    for mode, payload in ((DEFLATED, zlib.compress(x, level)), (PLANAR, bytes([pad]) + zlib.compress(planes.tobytes(), level)), (RUNS, zlib.compress(K.rle(a).tobytes(), level))):
        if len(payload) < len(best[1]):
            best = mode, payload
    return best


def unpack_block(mode: int, payload: bytes) -> bytes:
    if mode == RAW:
        return payload
    if mode == DEFLATED:
        return zlib.decompress(payload)
    if mode == PLANAR:
        return K.from_planes(K.as_bytes(zlib.decompress(payload[1:])), 4, payload[0], reverse=False).tobytes()
    if mode == RUNS:
        return K.unrle(K.as_bytes(zlib.decompress(payload))).tobytes()
    raise ValueError(f"unknown block mode {mode}")


def pack_sorted(x: bytes) -> bytes:
    """Burrows-Wheeler, move-to-front, zero runs, deflate."""
    last, primary = K.bwt(K.as_bytes(x))
    return K.varint(primary) + zlib.compress(K.rle_zero(K.mtf(last)).tobytes(), 9)


def unpack_sorted(y: bytes) -> bytes:
    primary, at = K.read_varint(y, 0)
    return K.unbwt(K.unmtf(K.unrle_zero(K.as_bytes(zlib.decompress(y[at:])))), primary).tobytes()


# --- arithmetic coding ---------------------------------------------------------------------------------------------

_TOP, _BOTTOM = 1 << 32, 1 << 24


class Encoder:
    """A range coder with a 33-bit low and carries into bytes already out."""

    def __init__(self):
        self.low, self.range, self.out = 0, _TOP - 1, bytearray()

    def encode(self, cum: int, freq: int, total: int) -> None:
        r = self.range // total
        self.low += r * cum
        self.range = r * freq if cum + freq < total else self.range - r * cum
        if self.low >= _TOP:
            self.low -= _TOP
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        while self.range < _BOTTOM:
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & _TOP - 1
            self.range <<= 8

    def finish(self) -> bytes:
        for _ in range(4):
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & _TOP - 1
        return bytes(self.out)


class Decoder:
    def __init__(self, data: bytes):
        self.data, self.at, self.range = data, 4, _TOP - 1
        self.code = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def target(self, total: int) -> int:
        self.unit = self.range // total
        return min(total - 1, self.code // self.unit)

    def consume(self, cum: int, freq: int, total: int) -> None:
        self.code -= self.unit * cum
        self.range = self.unit * freq if cum + freq < total else self.range - self.unit * cum
        while self.range < _BOTTOM:
            self.code = self.code << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.range <<= 8


class Model(ABC):
    """A probability model for a coder: frequencies of all 256 bytes, and what to learn from the one that came."""

    @abstractmethod
    def frequencies(self) -> np.ndarray:
        """Whole numbers, each at least 1, under 2**16 in sum."""

    @abstractmethod
    def learn(self, symbol: int) -> None: ...


class Uniform(Model):
    def frequencies(self) -> np.ndarray:
        return np.ones(256, np.int64)

    def learn(self, symbol: int) -> None:
        pass


class Adaptive(Model):
    """One table of counts, halved when they grow."""

    def __init__(self, step: int = 16, limit: int = 32_000):
        self.f, self.step, self.limit = np.ones(256, np.int64), step, limit

    def frequencies(self) -> np.ndarray:
        return self.f

    def learn(self, symbol: int) -> None:
        self.f[symbol] += self.step
        if self.f.sum() > self.limit:
            self.f = np.maximum(1, self.f >> 1)


class Hashed(Model):
    """A table of counts for each of `buckets` contexts of the last two bytes."""

    def __init__(self, buckets: int = 4096):
        self.buckets, self.tables, self.last = buckets, {}, 0

    def _own(self) -> Adaptive:
        return self.tables.setdefault(self.last * 2654435761 % _TOP % self.buckets, Adaptive())

    def frequencies(self) -> np.ndarray:
        return self._own().frequencies()

    def learn(self, symbol: int) -> None:
        self._own().learn(symbol)
        self.last = (self.last << 8 | symbol) & 0xFFFF


class PartialMatch(Model):
    """Contexts of up to `order` bytes, blended from short to long, with a correction that is learnt for each short context."""

    def __init__(self, order: int = 16, rate: float = 0.01):
        self.order, self.rate, self.history = order, rate, b""
        self.tables: list[dict[bytes, dict[int, int]]] = [{} for _ in range(order + 1)]
        self.shift: dict[bytes, np.ndarray] = {}

    def _probabilities(self) -> np.ndarray:
        p = np.full(256, 1 / 256)
        for k in range(self.order + 1):
            seen = self.tables[k].get(self.history[len(self.history) - k :]) if len(self.history) >= k else None
            if seen is None:
                break
            n = sum(seen.values())
            own = np.zeros(256)
            own[list(seen)] = list(seen.values())
            trust = n / (n + len(seen))
            p = (1 - trust) * p + trust * own / n
        p = np.maximum(p + self.shift.get(self.history[-2:], 0.0), 1e-7)
        return p / p.sum()

    def frequencies(self) -> np.ndarray:
        self.p = self._probabilities()
        return np.maximum(1, np.rint(self.p * 60_000)).astype(np.int64)

    def learn(self, symbol: int) -> None:
        error = -self.p * self.rate
        error[symbol] += self.rate
        key = self.history[-2:]
        self.shift[key] = np.clip(self.shift.get(key, 0.0) + error, -0.2, 0.2)
        for k in range(min(self.order, len(self.history)) + 1):
            t = self.tables[k].setdefault(self.history[len(self.history) - k :], {})
            t[symbol] = t.get(symbol, 0) + 1
        self.history = (self.history + bytes([symbol]))[-self.order :]


def encode_bytes(x: bytes, model: Model) -> bytes:
    e = Encoder()
    for b in x:
        f = model.frequencies()
        e.encode(int(f[:b].sum()), int(f[b]), int(f.sum()))
        model.learn(b)
    return K.varint(len(x)) + e.finish()


def decode_bytes(y: bytes, model: Model) -> bytes:
    n, at = K.read_varint(y, 0)
    d, out = Decoder(y[at:]), bytearray()
    for _ in range(n):
        f = model.frequencies()
        ends = np.cumsum(f)
        b = int(np.searchsorted(ends, d.target(int(ends[-1])), side="right"))
        d.consume(int(ends[b] - f[b]), int(f[b]), int(ends[-1]))
        model.learn(b)
        out.append(b)
    return bytes(out)


class BitMixer:
    """Four bit models (orders 0 to 2 and a run of equal bytes), mixed by weights that are learnt online in the logistic domain."""

    def __init__(self, rate: float = 0.015):
        self.rate, self.w, self.counts, self.history = rate, np.full(4, 0.3), {}, (0, 0)
        self.node = 1

    def _keys(self) -> list:
        a, b = self.history
        return [(0, self.node), (1, a, self.node), (2, a, b, self.node), (3, a == b, a, self.node)]

    def p1(self) -> int:
        """Probability of a 1, of 2**14."""
        p = []
        for k in self._keys():
            zero, one = self.counts.get(k, (1, 1))
            p.append(min(max(one / (zero + one), 1e-4), 1 - 1e-4))
        self.x = np.array([math.log(q / (1 - q)) for q in p])
        self.p = 1 / (1 + math.exp(-min(max(float(self.w @ self.x), -12), 12)))
        return min(max(int(self.p * 16_384), 1), 16_383)

    def learn(self, bit: int) -> None:
        self.w = np.clip(self.w + self.rate * (bit - self.p) * self.x, -4, 4)
        for k in self._keys():
            zero, one = self.counts.get(k, (1, 1))
            zero, one = (zero, one + 4) if bit else (zero + 4, one)
            self.counts[k] = (zero, one) if zero + one <= 4000 else (max(1, zero >> 1), max(1, one >> 1))
        self.node = self.node << 1 | bit
        if self.node > 255:
            self.history, self.node = (self.node & 255, self.history[0]), 1


def encode_bits(x: bytes) -> bytes:
    e, m = Encoder(), BitMixer()
    for b in x:
        for k in range(7, -1, -1):
            p, bit = m.p1(), b >> k & 1
            e.encode(*((16_384 - p, p) if bit else (0, 16_384 - p)), 16_384)
            m.learn(bit)
    return struct.pack(">I", len(x)) + e.finish()


def decode_bits(y: bytes) -> bytes:
    (n,), d, m, out = struct.unpack(">I", y[:4]), Decoder(y[4:]), BitMixer(), bytearray()
    for _ in range(n):
        b = 0
        for _ in range(8):
            p = m.p1()
            bit = int(d.target(16_384) >= 16_384 - p)
            d.consume(*((16_384 - p, p) if bit else (0, 16_384 - p)), 16_384)
            m.learn(bit)
            b = b << 1 | bit
        out.append(b)
    return bytes(out)


#: Codecs of our own; the sequential ones are meant for values of up to about a megabyte.
OWN: dict[str, tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]] = {
    "block": (lambda x: (lambda m: bytes([m[0]]) + m[1])(pack_block(x)), lambda y: unpack_block(y[0], y[1:])),
    "sorted": (pack_sorted, unpack_sorted),
    "xor_hashed": (lambda x: encode_bytes(K.xor_blocks(K.as_bytes(x)).tobytes(), Hashed()), lambda y: K.unxor_blocks(K.as_bytes(decode_bytes(y, Hashed()))).tobytes()),
    "partial_match": (lambda x: encode_bytes(x, PartialMatch()), lambda y: decode_bytes(y, PartialMatch())),
    "bit_mixer": (encode_bits, decode_bits),
}
CODECS = LIBRARY | OWN
#: Bytes of a text or of floats before a codec gets them.
LAYOUTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"raw": lambda x: x, "planes": lambda x: K.to_planes(x, 4)[0], "delta": K.delta, "planes_delta": lambda x: K.shuffle(x, 4, True)[0], "big_endian": K.byte_swap, "ordinal": K.ordinal}
