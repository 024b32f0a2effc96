"""Archives and block streams: containers of many files with checks, written and read in parallel.

A table of containers is one archive: each task packs the rows it has into containers of a bounded size, so writing and reading need
no coordination and no container is larger than a task's memory allows.  A container is bytes:

    magic, version, flags, varint n, n index entries, varint and vocabulary, varint and dictionary, blocks, footer and CRC-32C over all before it

An index entry is the path, the original length, the length as it is stored, the packed byte (pad, element size, mode) and a byte of
flags; where files are packed alone, also the codec and the packed length.  Every file is treated by its route (`plans.route`):
text may become word tokens, tensors, audio and images become planes, with low bits cleared first if that was asked for,
and what is packed already is stored.  A solid container has one block for each mode: the bodies, without repeated 4 KiB parts.
Codecs compete for every block, or for every file; the smallest result stays, of equals the first.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.functions import kernels as K
from quartzite.functions import words as W
from quartzite.functions.arrow import bound_batches, spread
from quartzite.functions.codecs import LIBRARY, pack_block, pack_sorted, train_dictionary, unpack_block, unpack_sorted, zstd
from quartzite.plans import route as R

MAGIC, VERSION, FOOTER = b"QZA1", 2, b"QCRC"
STREAM, BLOCK = b"QZS1", 128 << 10
#: Content bytes of one container, about.
PART_BYTES = 8 << 20
#: Codecs by number: what is stored must not depend on what is installed where it is read.
NAMES = ("raw", "zlib6", "bzip2", "lzma9", "zstd19", "zstd1", "zstd9", "zstd12", "zstd22", "brotli7", "brotli9", "brotli11", "sorted", "dictionary")
#: Candidates for a block, and for a file alone, by speed.
CANDIDATES = {"fast": ("zstd1",), "normal": ("zstd19", "bzip2", "brotli9", "sorted"), "best": ("zstd22", "lzma9", "bzip2", "brotli11", "sorted")}
ALONE = {"fast": ("zstd1",), "normal": ("dictionary", "zstd9", "brotli7", "sorted"), "best": ("dictionary", "zstd22", "lzma9", "brotli11", "sorted")}
#: Bytes that a codec is tried on: it is slow to start on fewer, or slow on more.
SIZES = {"lzma9": (64 << 10, 1 << 62), "brotli7": (0, 10 << 20), "brotli9": (0, 50 << 20), "brotli11": (0, 50 << 20), "sorted": (4096, 1_500_000)}
#: What zstd at its fastest doesn't make this much smaller isn't tried further.
HOPELESS = 0.98
#: Flags of a container, and of a file.
SOLID, LOSSY = 1, 2
TOKENS = 1
DEDUP_BLOCK = 4096
MODES = (R.GENERIC, R.WORDS, R.PLANES, R.STORED)
_ELEMS = {1: 0, 2: 1, 4: 2, 3: 3}


@dataclass(frozen=True)
class Settings:
    """solid: files of a container are packed together.  lossy: 0, or how many low bits may go (see `mask_bits`).  speed: fast, normal or best."""

    solid: bool = True
    lossy: int = 0
    speed: str = "normal"


def checked(body: bytes) -> bytes:
    return body + FOOTER + K.crc32c(K.as_bytes(body)).to_bytes(4, "little")


def verified(data: bytes) -> bytes:
    if data[-8:-4] != FOOTER or K.crc32c(K.as_bytes(data[:-8])) != int.from_bytes(data[-4:], "little"):
        raise ValueError("the archive's checksum is wrong")
    return data[:-8]


def safe(path: str) -> str:
    """A stored path must stay under the folder it is restored to."""
    if path.startswith(("/", "\\")) or ":" in path.split("/")[0] or ".." in path.replace("\\", "/").split("/"):
        raise ValueError(f"unsafe path {path!r}")
    return path


def _packed(name: str, x: bytes, dictionary: bytes) -> bytes | None:
    """`x` by a codec; null where that isn't installed or not meant for this size."""
    lo, hi = SIZES.get(name, (0, 1 << 62))
    if not lo <= len(x) <= hi:
        return None
    if name == "sorted":
        return pack_sorted(x)
    if name == "dictionary":
        return zstd(9, dictionary)[0](x) if dictionary and "zstd9" in LIBRARY else None
    return LIBRARY[name][0](x) if name in LIBRARY else None


def smallest(x: bytes, names: Iterable[str], dictionary: bytes = b"") -> tuple[int, bytes]:
    """(codec, packed) of the smallest result; of equals the first, and raw before all."""
    best, fast = (0, x), LIBRARY.get("zstd1", LIBRARY["zlib6"])[0]
    names = [n for n in names if n in LIBRARY or n in ("sorted", "dictionary")] or ["zlib6"]
    if len(x) > DEDUP_BLOCK and len(fast(x)) > HOPELESS * len(x):
        names = names[:1]
    for name in names:
        y = _packed(name, x, dictionary)
        if y is not None and len(y) < len(best[1]):
            best = (NAMES.index(name), y)
    return best


def expand(codec: int, y: bytes, dictionary: bytes = b"") -> bytes:
    name = NAMES[codec]
    if name == "raw":
        return y
    if name == "sorted":
        return unpack_sorted(y)
    return zstd(9, dictionary)[1](y) if name == "dictionary" else LIBRARY[name][1](y)


def dedup(x: bytes, size: int = DEDUP_BLOCK) -> tuple[bytes, list[int]]:
    """Distinct blocks in order, and for each block of `x` which one it is."""
    seen: dict[bytes, int] = {}
    index = [seen.setdefault(x[i : i + size], len(seen)) for i in range(0, len(x), size)]
    return b"".join(seen), index


def redup(unique: bytes, index: list[int], size: int = DEDUP_BLOCK) -> bytes:
    return b"".join(unique[i * size : (i + 1) * size] for i in index)


def masked(path: str, x: np.ndarray, level: int) -> np.ndarray:
    """Low bits cleared by the type of file: samples of audio and colours of images lose a few bits, floats those of `mask_bits`."""
    ext = R.suffix(path)
    if level > 0 and ext in R.AUDIO:
        return K.mask_pcm(x, level)
    if level > 0 and ext in R.IMAGE:
        return K.mask_pixels(x, level, 54 if ext == ".bmp" else 0)
    return K.mask_floats(x, level) if level > 0 and ext in R.TENSOR else x


def treated(path: str, content: bytes, lossy: int) -> tuple[int, int, int, bytes]:
    """(mode, element size, pad, body) of a file: all that isn't text is done here."""
    mode, elem = R.route_one(path, content, lossy > 0)
    if mode != R.PLANES:
        return mode, elem, 0, content
    x = masked(path, K.as_bytes(content), lossy)
    planes, pad = K.shuffle(x, elem, with_delta=R.suffix(path) not in R.TENSOR)
    return mode, elem, pad, planes.tobytes()


def untreated(path: str, body: bytes, mode: int, elem: int, pad: int) -> bytes:
    return K.unshuffle(K.as_bytes(body), elem, pad, with_delta=R.suffix(path) not in R.TENSOR).tobytes() if mode == R.PLANES else body


def _token_probe(texts: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """(vocabulary, texts as tokens) where these and the vocabulary are smaller by a fast codec than the texts; else nothing."""
    fast = LIBRARY.get("zstd3", LIBRARY["zlib6"])[0]
    vocabulary = W.learn(texts)
    if not vocabulary:
        return [], []
    table = W.forms(vocabulary)
    tokens = [W.encode(x, table) for x in texts]
    after = len(fast(b"".join(tokens))) + len(fast(b"\n".join(vocabulary)))
    return (vocabulary, tokens) if after < len(fast(b"".join(texts))) else ([], [])


def _field(x: bytes) -> bytes:
    return K.varint(len(x)) + x


def pack(files: Iterable[tuple[str, bytes]], settings: Settings | bool = True) -> bytes:
    """One container.  Paths go in ascending order, whatever the order of `files`."""
    s = settings if isinstance(settings, Settings) else Settings(solid=settings)
    files = sorted(files, key=lambda f: f[0])
    done = [(safe(p), len(c), *treated(p, c, s.lossy)) for p, c in files]
    at = [i for i, d in enumerate(done) if d[2] == R.WORDS]
    vocabulary, tokens = _token_probe([done[i][5] for i in at])
    bodies, flags = [d[5] for d in done], [0] * len(done)
    for i, t in zip(at, tokens, strict=False):
        bodies[i], flags[i] = t, TOKENS
    dictionary = b""
    if not s.solid and s.speed != "fast":
        samples = [b for (p, *_), b in zip(done, bodies, strict=True) if R.suffix(p) in R.SAMPLED and 0 < len(b) < 2 * R.MIB]
        dictionary = train_dictionary(samples[: R.MAX_SAMPLES], R.capacity_of(len(samples[: R.MAX_SAMPLES]), sum(map(len, samples))))
    index, blocks = bytearray(), bytearray()
    for (path, n, mode, elem, pad, _), body, flag in zip(done, bodies, flags, strict=True):
        index += _field(path.encode()) + K.varint(n) + K.varint(len(body)) + bytes([pad | _ELEMS[elem] << 2 | mode << 5, flag])
        if not s.solid:
            codec, y = smallest(body, ("zstd1",) if mode == R.STORED else ALONE[s.speed], dictionary)
            index += bytes([codec]) + K.varint(len(y))
            blocks += y
    for mode in MODES if s.solid else ():
        own = [b for d, b in zip(done, bodies, strict=True) if d[2] == mode]
        if not own:
            continue
        padded = b"".join(b + b"\0" * (-len(b) % DEDUP_BLOCK) for b in own)
        unique, order = dedup(padded)
        less = len(unique) < len(padded)
        codec, y = smallest(unique if less else b"".join(own), ("zstd1",) if mode == R.STORED else CANDIDATES[s.speed])
        blocks += bytes([mode, codec]) + _field(b"".join(map(K.varint, order)) if less else b"") + _field(y)
    packed = LIBRARY["zlib6"][0](b"\n".join(vocabulary)) if vocabulary else b""
    flags_byte = (SOLID if s.solid else 0) | (LOSSY if s.lossy > 0 else 0)
    return checked(MAGIC + bytes([VERSION, flags_byte]) + K.varint(len(done)) + bytes(index) + _field(packed) + _field(dictionary) + bytes(blocks))


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def varint(self) -> int:
        n, self.at = K.read_varint(self.data, self.at)
        return n

    def bytes(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("the archive ends too early")
        return self.data[self.at - n : self.at]


def entries(data: bytes) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(path, mode, element size, pad, content) of a container's files, in the order of their paths."""
    body = verified(data)
    if body[:4] != MAGIC or body[4] != VERSION:
        raise ValueError("not an archive of this version")
    solid, lossy, r = bool(body[5] & SOLID), bool(body[5] & LOSSY), _Reader(body, 6)
    index = []
    for _ in range(r.varint()):
        path, n, stored = safe(r.bytes(r.varint()).decode()), r.varint(), r.varint()
        packed, flag = r.bytes(2)
        index.append((path, n, stored, packed, flag, *((r.bytes(1)[0], r.varint()) if not solid else (0, 0))))
    vocabulary = r.bytes(r.varint())
    vocabulary = LIBRARY["zlib6"][1](vocabulary).split(b"\n") if vocabulary else []
    meaning = W.inverse(vocabulary)
    dictionary = r.bytes(r.varint())
    blocks: dict[int, tuple[bytes, int]] = {}
    while solid and r.at < len(body):
        mode, codec = r.bytes(2)
        order, y = r.bytes(r.varint()), expand(codec, r.bytes(r.varint()))
        if order:
            o, numbers = _Reader(order, 0), []
            while o.at < len(order):
                numbers.append(o.varint())
            y = redup(y, numbers)
        blocks[mode] = (y, DEDUP_BLOCK if order else 1)
    place = dict.fromkeys(MODES, 0)
    for path, n, stored, packed, flag, codec, size in index:
        pad, elem, mode = packed & 3, (1, 2, 4, 3)[packed >> 2 & 3], packed >> 5
        if solid:
            block, step = blocks[mode]
            x = block[place[mode] : place[mode] + stored]
            place[mode] += -(-stored // step) * step
        else:
            x = expand(codec, r.bytes(size), dictionary)
        x = untreated(path, W.decode(x, meaning) if flag & TOKENS else x, mode, elem, pad)
        if len(x) != n:
            raise ValueError(f"{path}: {len(x)} bytes, not {n}" + " (low bits were cleared)" * lossy)
        yield path, mode, elem, pad, x


def unpack(data: bytes) -> Iterator[tuple[str, bytes]]:
    for path, _, _, _, content in entries(data):
        yield path, content


def containers(files: Iterable[tuple[str, bytes]], settings: Settings | bool) -> Iterator[tuple[int, int, bytes]]:
    """(files, bytes, container) of runs of files."""
    held, size = [], 0
    for path, content in files:
        held.append((path, content or b""))
        size += len(content or b"")
        if size >= PART_BYTES:
            yield len(held), size, pack(held, settings)
            held, size = [], 0
    if held:
        yield len(held), size, pack(held, settings)


def _pack_rows(batches: Iterator[pa.RecordBatch], settings: Settings | bool) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for made, (n, size, x) in enumerate(containers(rows, settings)):
        yield pa.RecordBatch.from_arrays([pa.array([f"{part:05d}-{made:05d}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([x], pa.binary())], ["part", "n_files", "n_bytes", "archive"])


ENTRY = "path string, mode int, elem int, pad int, content binary"


def _unpack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            cols = list(zip(*entries(x), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["path", "mode", "elem", "pad", "content"])


def packed_rows(files: DataFrame, settings: Settings | bool = True, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(part, n_files, n_bytes, archive): containers of (path, content) rows.  Null contents are empty files; unsafe paths are an error."""
    bound_batches(files)
    src = spread(files.select(F.col(path_col).cast("string").alias("path"), F.col(content_col).cast("binary").alias("content")))
    return src.mapInArrow(partial(_pack_rows, settings=settings), "part string, n_files long, n_bytes long, archive binary")


def write_archive(files: DataFrame, path: str, settings: Settings | bool = True, path_col: str = "path", content_col: str = "content") -> None:
    """Write `packed_rows` as a table."""
    packed_rows(files, settings, path_col, content_col).write.parquet(path)


def unpacked_rows(archives: DataFrame) -> DataFrame:
    """(path, mode, elem, pad, content) of the one column of `archives`; a damaged container is an error."""
    return spread(archives).mapInArrow(_unpack_rows, ENTRY)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """`unpacked_rows` of a table of containers."""
    return unpacked_rows(spark.read.parquet(path).select("archive"))


def read_archive_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of containers that are files of their own."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unpack_rows, ENTRY)


def _restore_rows(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    made: set[str] = set()
    for batch in batches:
        names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name, content in zip(names, contents, strict=True):
            place = f"{root.rstrip('/')}/{safe(name)}"
            parent = place.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            with store.open_output_stream(place) as out:
                out.write(content)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(c) for c in contents], pa.int64())], ["path", "n"])


def restore_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (path, content) rows as a tree of files under `folder`, from the tasks; (path, n) of each.  `folder` must be one that all executors share."""
    return rows.select("path", "content").mapInArrow(partial(_restore_rows, folder=folder), "path string, n long")


# --- block streams -------------------------------------------------------------------------------------------------


def pack_stream(x: bytes, size: int = BLOCK) -> bytes:
    out = bytearray(STREAM + K.varint(len(x)) + K.varint(size))
    for i in range(0, len(x), size):
        block = x[i : i + size]
        mode, payload = pack_block(block)
        out += bytes([mode]) + K.varint(len(block)) + K.varint(len(payload)) + K.crc32c(K.as_bytes(block)).to_bytes(4, "little") + payload
    return bytes(out)


def unpack_stream(data: bytes) -> bytes:
    if data[:4] != STREAM:
        raise ValueError("not a block stream")
    total, at = K.read_varint(data, 4)
    _, at = K.read_varint(data, at)
    out = bytearray()
    while len(out) < total:
        mode, at = data[at], at + 1
        n, at = K.read_varint(data, at)
        m, at = K.read_varint(data, at)
        crc, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        try:
            block = unpack_block(mode, data[at : at + m])
        except zlib.error as e:
            raise ValueError(f"a block can't be unpacked: {e}") from e
        at += m
        if len(block) != n or K.crc32c(K.as_bytes(block)) != crc:
            raise ValueError("a block's checksum is wrong")
        out += block
    if len(out) != total:
        raise ValueError("the stream's size is wrong")
    return bytes(out)


def block_rows(x: np.ndarray, size: int = BLOCK):
    """(block_no, mode, bytes, packed bytes, crc, MD5 of the restored block) of each block."""
    for i in range(0, len(x), size):
        block = x[i : i + size].tobytes()
        mode, payload = pack_block(block)
        yield i // size, mode, len(block), len(payload), K.crc32c(x[i : i + size]), hashlib.md5(unpack_block(mode, payload)).hexdigest()
