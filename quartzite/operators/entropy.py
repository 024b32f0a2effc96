"""Byte histograms, entropies and contexts of texts and of float planes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions.arrow import bound_batches, map_bytes
from quartzite.functions.columns import byte_swap, float_bits, plane
from quartzite.functions.kernels import as_bytes, entropy, xor_blocks
from quartzite.sources.tables import table


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str | None, np.ndarray] = {}
    for batch in batches:
        for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            n = np.bincount(as_bytes(x.as_buffer() if x.is_valid else None), minlength=256)
            total[key] = total[key] + n if key in total else n
    rows = [(k, int(b), int(n[b])) for k, n in total.items() for b in np.flatnonzero(n)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["key", "b", "n"])


def byte_histogram(df: DataFrame, col: str = "text", key: Column | None = None) -> DataFrame:
    """(key, b, n): how often each byte occurs.  A task sends 256 rows a key at most; null and empty values have no bytes."""
    bound_batches(df)
    src = df.select((F.lit(None) if key is None else key).cast("string").alias("key"), F.encode(F.col(col).cast("string"), "UTF-8").alias("x"))
    return src.mapInArrow(_histogram, "key string, b int, n long").groupBy("key", "b").agg(F.sum("n").alias("n"))


def entropy_of(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy in bits a symbol of counts, by keys: from sums of n and n log2 n, in one aggregation."""
    s = F.sum(n)
    return counts.groupBy(*keys).agg(s.alias("total"), (F.log2(s) - F.sum(F.col(n) * F.log2(n)) / s).alias("entropy"))


def bounds(total: Column, h: Column) -> tuple[Column, Column]:
    """Bytes that a memoryless code needs, and the ratio this gives."""
    least = F.ceil(h * total / 8)
    return least, F.round(total / F.greatest(least, F.lit(1)), 3)


def _document_entropy(x: np.ndarray) -> tuple:
    h = round(entropy(np.bincount(x, minlength=256)), 4) + 0.0
    least = math.ceil(h * len(x) / 8)
    return len(x), h, least, len(x) / max(1, least)


def byte_entropy(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """Per row: bytes, entropy, least bytes, greatest ratio.  Nothing has entropy 0."""
    out = map_bytes(df, col, _document_entropy, "total_bytes long, entropy_bits_per_byte double, theoretical_min_bytes long, r double", [id_col])
    return out.select(id_col, "total_bytes", "entropy_bits_per_byte", "theoretical_min_bytes", F.round("r", 3).alias("max_theoretical_ratio"))


def _contexts(x: np.ndarray) -> tuple:
    y = x.astype(np.int64)
    return tuple(len(np.unique(sum(y[k : len(y) - o + 1 + k] << (8 * k) for k in range(o)))) if len(y) >= o else 0 for o in (1, 2, 3))


def _zero_share(x: np.ndarray) -> tuple:
    return len(x), int((x == 0).sum()), int((xor_blocks(x) == 0).sum())


def float_planes(df: DataFrame, col: str = "embedding") -> DataFrame:
    """b3 (highest) to b0 of each float of an array column."""
    u = df.select(F.explode(col).alias("x")).where("x is not null").select(float_bits(F.col("x")).alias("u"))
    return u.select(*(plane(F.col("u"), k).alias(f"b{k}") for k in (3, 2, 1, 0)))


def plane_entropy(planes: DataFrame) -> DataFrame:
    long = planes.select(F.explode(F.array(*(F.struct(F.lit(k).alias("plane"), F.col(f"b{k}").alias("b")) for k in range(4)))).alias("p")).select("p.*")
    return entropy_of(long.groupBy("plane", "b").agg(F.count("*").alias("n")), ["plane"])


def conditional_entropy(planes: DataFrame) -> DataFrame:
    """H(b2 | b3), H(b1 | b3 b2), H(b0 | b3 b2 b1) with the number of contexts: joint less marginal entropy, all levels in one pass of grouping sets."""
    cols = ["b3", "b2", "b1", "b0"]
    counts = planes.rollup(*cols).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    depth = F.when(F.col("g") == 7, 1).when(F.col("g") == 3, 2).when(F.col("g") == 1, 3).when(F.col("g") == 0, 4)
    by = entropy_of(counts.select(depth.alias("depth"), "n").where("depth is not null"), ["depth"])
    by = by.join(counts.select(depth.alias("depth")).groupBy("depth").agg(F.count("*").alias("contexts")), "depth")
    a, b = by.alias("a"), by.alias("b")
    pair = a.join(b, F.col("a.depth") == F.col("b.depth") - 1)
    return pair.select((4 - F.col("b.depth")).cast("int").alias("plane"), F.col("a.contexts").alias("contexts"), (F.col("b.entropy") - F.col("a.entropy")).alias("entropy"))


def context_gain(planes: DataFrame) -> DataFrame:
    """How much of each plane's entropy its context takes away, in per cent."""
    m, c = plane_entropy(planes).withColumnRenamed("entropy", "h"), conditional_entropy(planes)
    return c.join(m, "plane").select("plane", F.round(F.when(F.col("h") > 0, 100 * (1 - F.col("entropy") / F.col("h"))).otherwise(0.0), 4).alias("gain_pct"))


#: (doc_id, pos, b): the bytes of all documents, for DuckDB.
BYTES = "b AS (SELECT doc_id, unnest(range(octet_length(encode(text)))) AS pos, CAST('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) AS INTEGER) AS b FROM documents)"
#: (vec_id, i, x, u): the floats of all embeddings and their bits, for DuckDB.
FLOATS = """f AS (SELECT vec_id, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CASE WHEN x = 0 THEN 0 ELSE CASE WHEN x < 0 THEN 2147483648 ELSE 0 END
 + CAST((floor(log2(abs(CAST(x AS DOUBLE)))) + 127) * 8388608 + (abs(CAST(x AS DOUBLE)) / pow(2.0, floor(log2(abs(CAST(x AS DOUBLE))))) - 1) * 8388608 AS BIGINT) END AS u
 FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings))"""
PLANES = "p AS (SELECT u // 16777216 AS b3, u // 65536 % 256 AS b2, u // 256 % 256 AS b1, u % 256 AS b0 FROM f)"

QUERIES = {
    "q_byte_histogram": lambda s, d: byte_histogram(table(s, d, "documents")).select("b", "n"),
    "q_byte_entropy": lambda s, d: byte_entropy(table(s, d, "documents")),
    "q_entropy_bounds": lambda s, d: (lambda e: e.select(F.col("key").alias("source"), F.col("total").alias("total_bytes"), F.round("entropy", 4).alias("entropy_bits_per_byte"), bounds(F.col("total"), F.round("entropy", 4))[0].alias("theoretical_min_bytes"), bounds(F.col("total"), F.round("entropy", 4))[1].alias("max_theoretical_ratio")))(entropy_of(byte_histogram(table(s, d, "documents"), key=F.col("source")), ["key"])),
    "q_distinct_contexts": lambda s, d: map_bytes(table(s, d, "documents"), "text", _contexts, "order1 long, order2 long, order3 long", ["doc_id"]),
    "q_zero_share": lambda s, d: map_bytes(table(s, d, "documents"), "text", _zero_share, "n long, zeros long, zeros_after_xor long", ["doc_id"]),
    "q_float_bits": lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), float_bits(F.col("x")).alias("bits")),
    "q_byte_planes": lambda s, d: float_planes(table(s, d, "embeddings")).groupBy("b3", "b2").agg(F.count("*").alias("n"), F.sum(F.col("b1").cast("long")).alias("sum_b1"), F.sum(F.col("b0").cast("long")).alias("sum_b0")),
    "q_byteswap": lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), byte_swap(float_bits(F.col("x"))).alias("swapped")),
    "q_plane_entropy": lambda s, d: plane_entropy(float_planes(table(s, d, "embeddings"))).select(F.col("plane").cast("int").alias("plane"), "total", F.round("entropy", 6).alias("entropy")),
    "q_cond_entropy": lambda s, d: conditional_entropy(float_planes(table(s, d, "embeddings"))).select("plane", "contexts", F.round("entropy", 6).alias("entropy")),
    "q_context_gain": lambda s, d: context_gain(float_planes(table(s, d, "embeddings"))),
}

_ENTROPY = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"
ORACLE_SQL = {
    "q_byte_histogram": f"WITH {BYTES} SELECT b, count(*) AS n FROM b GROUP BY b",
    "q_byte_entropy": f"""WITH {BYTES}, c AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY doc_id, b), h AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS t, abs(round({_ENTROPY}, 4)) AS h FROM c GROUP BY doc_id),
a AS (SELECT doc_id, coalesce(t, 0) AS t, coalesce(h, 0.0) AS h FROM documents LEFT JOIN h USING (doc_id))
SELECT doc_id, t AS total_bytes, h AS entropy_bits_per_byte, CAST(ceil(h * t / 8) AS BIGINT) AS theoretical_min_bytes, round(t / greatest(ceil(h * t / 8), 1), 3) AS max_theoretical_ratio FROM a""",
    "q_entropy_bounds": f"""WITH {BYTES}, c AS (SELECT source, b, count(*) AS n FROM b JOIN documents USING (doc_id) GROUP BY source, b), h AS (SELECT source, CAST(sum(n) AS BIGINT) AS t, round({_ENTROPY}, 4) AS h FROM c GROUP BY source)
SELECT source, t AS total_bytes, h AS entropy_bits_per_byte, CAST(ceil(h * t / 8) AS BIGINT) AS theoretical_min_bytes, round(t / greatest(ceil(h * t / 8), 1), 3) AS max_theoretical_ratio FROM h""",
    "q_distinct_contexts": f"""WITH {BYTES}, w AS (SELECT doc_id, b, lead(b, 1) OVER d AS c, lead(b, 2) OVER d AS e FROM b WINDOW d AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, count(DISTINCT b) AS order1, count(DISTINCT b * 256 + c) AS order2, count(DISTINCT (b * 256 + c) * 256 + e) AS order3 FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id""",
    "q_zero_share": f"""WITH {BYTES}, x AS (SELECT doc_id, pos, b, CASE WHEN pos % 64 > 0 AND pos < n // 64 * 64 THEN xor(b, lag(b) OVER (PARTITION BY doc_id ORDER BY pos)) ELSE b END AS y FROM b JOIN (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) USING (doc_id))
SELECT doc_id, count(b) AS n, CAST(coalesce(sum(CASE WHEN b = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS zeros, CAST(coalesce(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END), 0) AS BIGINT) AS zeros_after_xor FROM documents LEFT JOIN x USING (doc_id) GROUP BY doc_id""",
    "q_float_bits": f"WITH {FLOATS} SELECT vec_id, i, CAST(u AS BIGINT) AS bits FROM f",
    "q_byte_planes": f"WITH {FLOATS}, {PLANES} SELECT CAST(b3 AS INTEGER) AS b3, CAST(b2 AS INTEGER) AS b2, count(*) AS n, CAST(sum(b1) AS BIGINT) AS sum_b1, CAST(sum(b0) AS BIGINT) AS sum_b0 FROM p GROUP BY b3, b2",
    "q_byteswap": f"WITH {FLOATS} SELECT vec_id, i, CAST(u % 256 * 16777216 + u // 256 % 256 * 65536 + u // 65536 % 256 * 256 + u // 16777216 AS BIGINT) AS swapped FROM f",
    "q_plane_entropy": f"""WITH {FLOATS}, {PLANES}, c AS (SELECT plane, b, count(*) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS plane, unnest([b0, b1, b2, b3]) AS b FROM p) GROUP BY plane, b)
SELECT plane, CAST(sum(n) AS BIGINT) AS total, round({_ENTROPY}, 6) AS entropy FROM c GROUP BY plane""",
    "q_cond_entropy": f"""WITH {FLOATS}, {PLANES}, c AS (SELECT 1 AS k, count(*) AS n FROM p GROUP BY b3 UNION ALL SELECT 2, count(*) FROM p GROUP BY b3, b2 UNION ALL SELECT 3, count(*) FROM p GROUP BY b3, b2, b1 UNION ALL SELECT 4, count(*) FROM p GROUP BY b3, b2, b1, b0),
h AS (SELECT k, {_ENTROPY} AS h, count(*) AS contexts FROM c GROUP BY k)
SELECT 4 - b.k AS plane, a.contexts, round(b.h - a.h, 6) AS entropy FROM h a JOIN h b ON a.k = b.k - 1""",
    "q_context_gain": f"""WITH {FLOATS}, {PLANES}, c AS (SELECT 1 AS k, count(*) AS n FROM p GROUP BY b3 UNION ALL SELECT 2, count(*) FROM p GROUP BY b3, b2 UNION ALL SELECT 3, count(*) FROM p GROUP BY b3, b2, b1 UNION ALL SELECT 4, count(*) FROM p GROUP BY b3, b2, b1, b0),
h AS (SELECT k, {_ENTROPY} AS h FROM c GROUP BY k), m AS (SELECT plane, {_ENTROPY} AS h FROM (SELECT plane, b, count(*) AS n FROM (SELECT unnest([0, 1, 2, 3]) AS plane, unnest([b0, b1, b2, b3]) AS b FROM p) GROUP BY plane, b) GROUP BY plane)
SELECT 4 - b.k AS plane, round(CASE WHEN m.h > 0 THEN 100 * (1 - (b.h - a.h) / m.h) ELSE 0.0 END, 4) AS gain_pct FROM h a JOIN h b ON a.k = b.k - 1 JOIN m ON m.plane = 4 - b.k""",
}
