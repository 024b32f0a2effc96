"""Generated inputs, decoding by format, and the test whether word tokens pay."""

from __future__ import annotations

import bz2
import gzip
import lzma
import re
from hashlib import md5
import zlib

import numpy as np
from pyspark.sql import functions as F

from quartzite.functions import codecs as X
from quartzite.functions.arrow import map_bytes
from quartzite.sources import generate as G
from quartzite.sources.tables import table


def decode_any(x: bytes) -> tuple[str, bytes]:
    """(codec, content) by the first bytes; what no codec can read is raw."""
    chain = [(b"\x28\xb5\x2f\xfd", "zstd", X.zstd(3)[1] if X.zstandard else None), (b"\xfd7zXZ\x00", "lzma", lzma.decompress), (b"BZh", "bzip2", bz2.decompress), (b"\x1f\x8b", "gzip", gzip.decompress), (b"\x78", "zlib", zlib.decompress)]
    for head, name, fn in chain:
        if fn and x.startswith(head):
            try:
                return name, fn(x)
            except Exception:  # looks like it, but isn't
                continue
    return "raw", x


def _mixed(x: np.ndarray) -> bytes:
    """A value packed by one codec or another, by its length."""
    data = x.tobytes()
    return (X.LIBRARY["zlib6"], X.LIBRARY["bzip2"], X.LIBRARY["gzip9"], X.LIBRARY["zstd3"] if X.zstandard else X.LIBRARY["zlib6"], (bytes, bytes))[len(data) % 5][0](data)


def _dispatch(x: np.ndarray) -> tuple:
    name, back = decode_any(_mixed(x))
    return name, len(back), md5(back).hexdigest()


_WORDS = re.compile(rb"[a-zA-Z]+")


def token_probe(x: np.ndarray) -> tuple:
    """(plain, tokens, kept): sizes after a fast compressor, of the text and of the text with its own frequent words as two bytes; tokens are kept where smaller."""
    data = x.tobytes()
    pack = (X.LIBRARY["zstd3"] if X.zstandard else X.LIBRARY["zlib6"])[0]
    counts: dict[bytes, int] = {}
    for w in _WORDS.findall(data):
        counts[w] = counts.get(w, 0) + 1
    top = sorted((w for w in counts if len(w) >= 4 and counts[w] > 1), key=lambda w: (-counts[w], w))[:8000]
    code = {w: bytes([0xC0 | i >> 8, i & 255]) for i, w in enumerate(top)}
    tokens = b" ".join(top) + b"\0" + _WORDS.sub(lambda m: code.get(m[0], m[0]), data)
    a, b = len(pack(data)), len(pack(tokens))
    return a, b, b < a


QUERIES = {
    "q_gen_wal": lambda s, d: G.wal(s, 2000),
    "q_gen_logs": lambda s, d: G.logs(s, 1000),
    "q_gen_csv": lambda s, d: G.rows_csv(s, 1000),
    "q_gen_dna": lambda s, d: G.dna(s, 200),
    "q_gen_grid": lambda s, d: G.grid(s, 64).select("x", "y", F.round("z", 6).alias("z")),
    "q_gen_weights": lambda s, d: G.weights(s, 4096).select("id", F.round("w", 9).alias("w")),
    "q_gen_assets": lambda s, d: G.assets(s, 20, 6),
    "q_gen_text": lambda s, d: G.text(s, 500),
    "q_gen_code": lambda s, d: G.code(s, 500),
    "q_gen_records": lambda s, d: G.records(s, 500),
    "q_gen_html": lambda s, d: G.html(s, 500),
    "q_gen_xml": lambda s, d: G.xml(s, 500),
    "q_gen_halves": lambda s, d: G.halves(s, 4096),
    "q_gen_mixed": lambda s, d: G.mixed(s, 200),
    "q_codec_dispatch": lambda s, d: map_bytes(table(s, d, "documents"), "text", _dispatch, "codec string, n long, md5 string", ["doc_id"]).select("doc_id", "n", "md5"),
    "q_token_probe": lambda s, d: map_bytes(table(s, d, "documents"), "text", token_probe, "plain long, tokens long, kept boolean", ["doc_id"]),
}


def _noise(i: str, salt: int, top: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST({i} AS VARCHAR) || '/{salt}'), 1, 12) AS BIGINT) % {top})"


_SAYS = f"(SELECT string_agg({list(G.WORDS)!r}[{_noise('(id * 12 + k)', 11, len(G.WORDS))} + 1], ' ' ORDER BY k) FROM range(12) u(k))"
_CODE = f"'def f' || id || '(x):' || chr(10) || '    return x * ' || {_noise('id', 12, 97)} || ' + ' || {_noise('id', 13, 1000)} || chr(10)"
_RECORD = f"'{{{{\"id\": ' || id || ', \"name\": \"user' || {_noise('id', 14, 500)} || '\", \"score\": ' || {_noise('id', 15, 100)} || ', \"tags\": [\"t' || {_noise('id', 16, 9)} || '\", \"t' || {_noise('id', 17, 9)} || '\"]}}}}'".replace("{{", "{").replace("}}", "}")
_XML = f"'<row id=\"' || id || '\"><v>' || {_noise('id', 19, 10000)} || '</v></row>'"
_HALF = f"(SELECT id, {_noise('id', 20, 2048)} AS m, {_noise('id', 21, 2)} AS s FROM range(4096) t(id))"
ORACLE_SQL = {
    "q_gen_text": f"SELECT id, {_SAYS} AS line FROM range(500) t(id)",
    "q_gen_code": f"SELECT id, {_CODE} AS line FROM range(500) t(id)",
    "q_gen_records": f"SELECT id, {_RECORD} AS line FROM range(500) t(id)",
    "q_gen_html": f"SELECT id, '<div class=\"c' || {_noise('id', 18, 7)} || '\"><p>' || {_SAYS} || '</p></div>' AS line FROM range(500) t(id)",
    "q_gen_xml": f"SELECT id, {_XML} AS line FROM range(500) t(id)",
    "q_gen_halves": f"SELECT id, CAST(s * 32768 + CASE WHEN m = 0 THEN 0 ELSE (floor(log2(m)) + 4) * 1024 + m * pow(2, 10 - floor(log2(m))) END AS INTEGER) AS bits FROM {_HALF}",
    "q_gen_mixed": f"SELECT printf('mixed/%05d', id) || ['.txt', '.py', '.json', '.xml'][id % 4 + 1] AS path, CASE id % 4 WHEN 0 THEN {_SAYS} WHEN 1 THEN {_CODE} WHEN 2 THEN {_RECORD} ELSE {_XML} END AS content FROM range(200) t(id)",
    "q_gen_wal": "SELECT id * 50 AS lsn, id // 4 AS tx, CAST(id * 7 % 3 AS INTEGER) AS op, md5(CAST(id AS VARCHAR)) AS payload FROM range(2000) t(id)",
    "q_gen_logs": f"SELECT id, '{{\"id\": ' || id || ', \"level\": \"' || ['INFO', 'DEBUG', 'WARN', 'ERROR'][{_noise('id', 1, 4)} + 1] || '\", \"loss\": ' || {_noise('id', 2, 1000)} || ', \"module\": \"m' || {_noise('id', 3, 9)} || '\"}}' AS line FROM range(1000) t(id)",
    "q_gen_csv": f"SELECT id, (id // 100) || ',' || (id % 100) || ',' || {_noise('id', 4, 100000)} || ',' || {_noise('id', 5, 1000)} AS line FROM range(1000) t(id)",
    "q_gen_dna": f"SELECT id, string_agg(substr('ACGT', {_noise('(id * 60 + k)', 6, 4)} + 1, 1), '' ORDER BY k) AS line FROM range(200) t(id), range(60) u(k) GROUP BY id",
    "q_gen_grid": "SELECT id % 64 AS x, id // 64 AS y, round(100 + 50 * sin((id % 64) / 16) * cos((id // 64) / 16), 6) AS z FROM range(4096) t(id)",
    "q_gen_weights": f"SELECT id, round(CASE WHEN id % 8 = 0 THEN 0 WHEN id % 8 = 1 THEN 1 ELSE ({_noise('id', 7, 1000)} + {_noise('id', 8, 1000)} + {_noise('id', 9, 1000)} + {_noise('id', 10, 1000)} - 1998) / CAST(20000 AS DOUBLE) END, 9) AS w FROM range(4096) t(id)",
    "q_gen_assets": "SELECT format('tex_{:03d}.raw', id) AS path, repeat(md5(CAST(id % 6 AS VARCHAR)), 128) AS content FROM range(20) t(id)",
    "q_codec_dispatch": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(encode(coalesce(text, ''))) AS md5 FROM documents",
}
