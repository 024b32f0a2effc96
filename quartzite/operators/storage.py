"""Codec trials, archives, block streams, zips, encryption and streams on the tables."""

from __future__ import annotations

import hashlib
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.functions import codecs as X
from quartzite.functions import security
from quartzite.functions.arrow import map_bytes, spread
from quartzite.operators.relational import best_ratio, codec_totals, scorecard, winner
from quartzite.operators.text import _SHARE
from quartzite.plans.route import TEXT_SHARE
from quartzite.sources import archive
from quartzite.sources.files import ordered, scan
from quartzite.sources.tables import table
from quartzite.sources.zips import zip_entries, zip_of
from quartzite.streaming import blocks as S

TRIAL = "layout string, codec string, ord int, n long, size long, comp_s double, decomp_s double, lossless boolean"


def trials(x: np.ndarray, names: tuple[str, ...], layouts: tuple[str, ...] = ("raw",)):
    """A row for each layout and codec: sizes, seconds, and whether all came back."""
    for layout in layouts:
        y = X.LAYOUTS[layout](x).tobytes()
        for i, name in enumerate(names):
            t = time.perf_counter()
            packed = X.CODECS[name][0](y)
            u = time.perf_counter()
            back = X.CODECS[name][1](packed)
            yield layout, name, i, len(x), len(packed), u - t, time.perf_counter() - u, back == y


def codec_trials(df: DataFrame, keep: str | list[str], col: str, names: tuple[str, ...], layouts: tuple[str, ...] = ("raw",)) -> DataFrame:
    """`keep` and a row for each layout and codec: measured, so the rows are spread over all cores first."""
    keep = [keep] if isinstance(keep, str) else keep
    return map_bytes(spread(df.select(*keep, col)), col, lambda x: trials(x, names, layouts), TRIAL, keep, many=True)


FAST = tuple(n for n in ("zlib6", "bzip2", "zstd3", "block") if n in X.CODECS)


def _trials(s, d):
    t = codec_trials(table(s, d, "documents"), "doc_id", "text", FAST, ("raw", "delta"))
    return t.groupBy("layout", "codec").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("lossless").alias("lossless"))


def floats_of(values: list | None) -> np.ndarray:
    """An array of floats as little-endian bytes; null counts as empty, a null component as 0."""
    return np.array([0.0 if v is None else v for v in values or ()], "<f4").view(np.uint8)


#: Codecs for floats, of those that are there.
DEEP = tuple(n for n in ("zstd3", "zstd22", "brotli11", "lzma9") if n in X.CODECS)


#: Vectors whose floats are packed together in a trial.
PACK = 4096


def _float_trials(s, d):
    """Every layout of the vectors' floats, in packs of one label, by every codec, with their restored bits."""
    v = table(s, d, "embeddings").groupBy("label", F.floor(F.col("vec_id") / PACK).alias("pack"))
    v = v.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("floats"))
    t = map_bytes(v, "floats", lambda x: trials(floats_of(x), DEEP, tuple(X.LAYOUTS)), TRIAL, ["label", "pack"], many=True)
    return t.groupBy("layout", "codec").agg(F.count("*").alias("n_packs"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.min("lossless").alias("lossless"))


def _measured(s, d):
    return codec_trials(table(s, d, "documents"), ["doc_id", "source"], "text", FAST).select("doc_id", "source", "codec", "ord", "n", "size", "lossless")


def _ordered(s, d):
    """The files of all documents, numbered by path."""
    files = _files(s, d).select("path", F.octet_length("content").cast("long").alias("n"))
    return ordered(files, "path", S.shared_folder(s))


#: Suffixes by document for the archive of all modes.
_KINDS = (".txt", ".pt", ".wav", ".zip", ".xyz", ".safetensors", ".jpg")


def _modes(s, d):
    end = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("doc_id", F.lit(len(_KINDS))) + 1).cast("int"))
    files = table(s, d, "documents").select(F.concat(F.lit("f/"), F.col("doc_id").cast("string"), end).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    path = S.shared_folder(s)
    archive.write_archive(files, path, archive.Settings(speed="fast"))
    return archive.read_archive(s, path).select("path", "mode", "elem", "pad", F.octet_length("content").cast("long").alias("n"), F.md5("content").alias("md5"))


def _restored(x: np.ndarray):
    """What every codec gives back."""
    for name, (pack, unpack) in X.CODECS.items():
        yield name, len(x), hashlib.md5(unpack(pack(x.tobytes()))).hexdigest()


def _best(s, d):
    return winner(codec_trials(table(s, d, "benchmark"), "item_id", "text", tuple(X.CODECS)), ["item_id"], F.col("size"), F.col("ord"))


def _sequential(s, d):
    t = codec_trials(table(s, d, "benchmark"), "item_id", "text", tuple(X.OWN))
    return t.select("item_id", "codec", "n", "size", "lossless")


def _files(s, d):
    docs = table(s, d, "documents")
    return docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))


def _archive(s, d, solid):
    path = S.shared_folder(s)
    archive.write_archive(_files(s, d), path, solid)
    return archive.read_archive(s, path).select("path", F.octet_length("content").cast("long").alias("n"), F.md5("content").alias("md5"))


def _zips(s, d):
    items = table(s, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("x"))
    made = map_bytes(items, "x", lambda x: (zip_of([("model/data/0", x.tobytes()), ("meta.json", b"{}"), ("notes.txt", x.tobytes()[:9])]),), "z binary", ["doc_id"])
    return zip_entries(made, "z", ["doc_id"]).select("doc_id", "name", "size", "method", "is_tensor", "is_metadata")


def _encrypted(s, d):
    docs = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("x"))
    sealed = security.encrypt(docs, "x", "a passphrase")
    opened = security.decrypt(sealed, "x", "a passphrase").select("doc_id", F.md5("x").alias("md5"))
    return opened


def _wrong_key(s, d):
    docs = table(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("x"))
    return security.decrypt(security.encrypt(docs, "x", "right"), "x", "wrong", strict=False).select("doc_id", F.col("x").isNull().alias("refused"))


def _streamed_blocks(s, d):
    out, check = S.shared_folder(s), S.shared_folder(s)
    S.stream_blocks(S.read_stream(s, f"{d}/documents.parquet"), "doc_id", "text", out, check).awaitTermination()
    return s.read.parquet(out).select("doc_id", "block_no", "n", "restored")


def _streamed_entropy(s, d):
    out, check = S.shared_folder(s), S.shared_folder(s)
    S.stream_histogram(S.read_stream(s, f"{d}/documents.parquet"), "text", "source", out, check).awaitTermination()
    return S.stream_entropy(s, out).select(F.col("key").alias("source"), F.col("total").alias("total_bytes"), F.round("entropy", 4).alias("entropy_bits_per_byte"))


def _dictionary(s, d):
    """Trained on the documents with the smallest hashes, up to a bound; its use on all."""
    docs = table(s, d, "documents")
    rows = docs.where(F.octet_length("text").between(1, 1 << 16)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(256).select("text").collect()
    trained = X.train_dictionary([r[0].encode() for r in rows], 32 << 10)
    return map_bytes(docs, "text", lambda x: (len(x), len(X.zstd(3)[0](x.tobytes())), len(X.zstd(3, trained)[0](x.tobytes()))), "n long, plain long, trained long", ["doc_id"])


def _streamed_online(s, d):
    out, check = S.shared_folder(s), S.shared_folder(s)
    S.stream_online(S.read_stream(s, f"{d}/events.parquet"), "event_type", "event_id", "props", out, check).awaitTermination()
    return s.read.parquet(out).groupBy("key").agg(F.max("n").alias("n"), F.max_by("bits", "n").alias("bits"), F.max_by("total", "n").alias("total")).select("key", "n", F.round("bits", 3).alias("bits"), "total")


QUERIES = {
    "q_stream_online": _streamed_online,
    "q_scan_files": lambda s, d: scan(s, d).select("relative", F.col("length").cast("long").alias("length")),
    "q_codec_trials": _trials,
    "q_codec_best": _best,
    "q_codec_restore": lambda s, d: map_bytes(spread(table(s, d, "benchmark").select("item_id", "text")), "text", _restored, "codec string, n long, md5 string", ["item_id"], many=True),
    "q_float_trials": _float_trials,
    "q_tournament": lambda s, d: winner(_measured(s, d), ["doc_id"], F.col("size"), F.col("ord")),
    "q_codec_totals": lambda s, d: codec_totals(_measured(s, d)),
    "q_codec_winner": lambda s, d: best_ratio(_measured(s, d), ["source"]),
    "q_scorecard": lambda s, d: scorecard(_measured(s, d), ["doc_id", "source", "n"], ["source"]),
    "q_file_order": _ordered,
    "q_archive_modes": _modes,
    "q_codec_sequential": _sequential,
    "q_archive_roundtrip": lambda s, d: _archive(s, d, True),
    "q_archive_files": lambda s, d: _archive(s, d, False),
    "q_block_stream": lambda s, d: map_bytes(table(s, d, "documents"), "text", lambda x: archive.block_rows(x, 4096), "block_no int, mode int, n long, packed long, crc long, restored string", ["doc_id"], many=True).select("doc_id", "block_no", "n", "restored"),
    "q_block_restore": lambda s, d: map_bytes(spread(table(s, d, "documents").select("doc_id", "text")), "text", lambda x: (len(x), hashlib.md5(archive.unpack_stream(archive.pack_stream(x.tobytes()))).hexdigest()), "n long, md5 string", ["doc_id"]),
    "q_zip_entries": _zips,
    "q_encrypt_roundtrip": _encrypted,
    "q_wrong_key": _wrong_key,
    "q_stream_blocks": _streamed_blocks,
    "q_stream_entropy": _streamed_entropy,
    "q_dict_train": _dictionary,
}

_FILE = "SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(encode(coalesce(text, ''))) AS md5 FROM documents"
_BLOCKS = "WITH n AS (SELECT doc_id, text, octet_length(encode(coalesce(text, ''))) AS n FROM documents), b AS (SELECT doc_id, text, n, unnest(range((n + {less}) // {size})) AS k FROM n) SELECT doc_id, CAST(k AS INTEGER) AS block_no, CAST(least({size}, n - k * {size}) AS BIGINT) AS n, md5(unhex(substr(hex(encode(text)), k * {hex} + 1, {hex}))) AS restored FROM b"
_KIND = f"list_value({', '.join(repr(x) for x in _KINDS)})[doc_id % {len(_KINDS)} + 1]"
ORACLE_SQL = {
    "q_codec_restore": f"SELECT item_id, unnest({list(X.CODECS)!r}) AS codec, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(encode(coalesce(text, ''))) AS md5 FROM benchmark",
    "q_file_order": f"SELECT path, n, CAST(row_number() OVER (ORDER BY path) - 1 AS BIGINT) AS place FROM ({_FILE})",
    "q_archive_modes": f"""WITH f AS (SELECT 'f/' || CAST(doc_id AS VARCHAR) || {_KIND} AS path, {_KIND} AS ext, coalesce(text <> '' AND {_SHARE} > {TEXT_SHARE}, false) AS says, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(encode(coalesce(text, ''))) AS md5 FROM documents)
SELECT path, CASE WHEN ext IN ('.txt') THEN 2 WHEN ext IN ('.pt', '.safetensors', '.wav', '.jpg') THEN 4 WHEN ext = '.zip' THEN 5 WHEN says THEN 2 ELSE 0 END AS mode, CASE WHEN ext IN ('.pt', '.safetensors') THEN 4 ELSE 1 END AS elem, CAST(CASE WHEN ext IN ('.pt', '.safetensors') THEN (4 - n % 4) % 4 ELSE 0 END AS INTEGER) AS pad, n, md5 FROM f""",
    "q_archive_roundtrip": _FILE,
    "q_archive_files": _FILE,
    "q_block_stream": _BLOCKS.format(size=4096, less=4095, hex=8192),
    "q_stream_blocks": _BLOCKS.format(size=archive.BLOCK, less=archive.BLOCK - 1, hex=2 * archive.BLOCK),
    "q_block_restore": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(encode(coalesce(text, ''))) AS md5 FROM documents",
    "q_zip_entries": "WITH n AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents) SELECT doc_id, unnest(['model/data/0', 'meta.json', 'notes.txt']) AS name, CAST(unnest([n, 2, least(n, 9)]) AS BIGINT) AS size, 0 AS method, unnest([true, false, false]) AS is_tensor, unnest([false, true, false]) AS is_metadata FROM n",
    "q_encrypt_roundtrip": "SELECT doc_id, md5(encode(text)) AS md5 FROM documents",
    "q_wrong_key": "SELECT doc_id, true AS refused FROM documents",
    "q_stream_entropy": """WITH b AS (SELECT source, CAST('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) AS INTEGER) AS b FROM documents), c AS (SELECT source, b, count(*) AS n FROM b GROUP BY source, b)
SELECT source, CAST(sum(n) AS BIGINT) AS total_bytes, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy_bits_per_byte FROM c GROUP BY source""",
}
