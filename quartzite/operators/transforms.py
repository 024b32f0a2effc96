"""Reversible byte transforms: differences, planes, runs, sorting; on texts as kernels, on float arrays as expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quartzite.functions import kernels as K
from quartzite.functions.arrow import bound_batches, buffers, map_bytes, spread
from quartzite.functions.columns import float_bits, from_ordinal, ordinal, padding, varint_len, wrap32, zigzag
from quartzite.operators.entropy import BYTES, FLOATS
from quartzite.sources.tables import table

#: Blocks of one value that are looked through for repeats at a time.
STRETCH = 1 << 16
#: Copies of a block that meet its bytes in one task.
SHARE = 256


def md5(x: np.ndarray) -> str:
    return hashlib.md5(x.tobytes()).hexdigest()


def transform_digest(df: DataFrame, id_col: str, col: str, **fns) -> DataFrame:
    """(id, n, md5 of each function's result): transforms never leave their row, so nothing shuffles."""
    schema = "n long, " + ", ".join(f"{k} string" for k in fns)
    return map_bytes(df, col, lambda x: (len(x), *(md5(f(x)) for f in fns.values())), schema, [id_col])


def mask_and_shuffle(x: np.ndarray, elem: int, level: int, kind: str) -> tuple[np.ndarray, int]:
    """Mask by the type of data, then planes; only what isn't a tensor is stored as differences."""
    if level:
        x = {"pcm": K.mask_pcm, "pixels": K.mask_pixels, "tensor": K.mask_floats}[kind](x, level)
    return K.shuffle(x, elem, with_delta=kind != "tensor")


def blocks(df: DataFrame, size: int, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """(id, block_no, block binary): slices of `size` bytes, the last may be shorter; empty values have none."""
    x = F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")
    n = F.octet_length(x)
    src = df.select(id_col, x.alias("x"), n.alias("n")).where("n > 0")
    src = src.select(id_col, "x", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / size).cast("int") - 1)).alias("block_no"))
    return src.select(id_col, "block_no", F.substring(F.col("x"), F.col("block_no") * size + 1, F.lit(size)).alias("block"))


def _distinct(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks with the places that they have in a stretch of a value; a batch goes on as soon as it has as many blocks as a stretch."""
    for batch in batches:
        rows, first, more, block = [], [], [], []
        for row, x in enumerate(batch.column(1)):
            x = memoryview(x.as_buffer() if x.is_valid else b"")
            for start in range(0, len(x), STRETCH * size):
                cut = [bytes(x[k : k + size]) for k in range(start, min(len(x), start + STRETCH * size), size)]
                at = range(start // size, start // size + len(cut))
                if len(set(cut)) == len(cut):
                    first += at
                    more += [None] * len(cut)
                else:
                    places: dict[bytes, list[int]] = {}
                    for k, v in zip(at, cut, strict=True):
                        places.setdefault(v, []).append(k)
                    cut = [*places]
                    first += (p[0] for p in places.values())
                    more += (p[1:] or None for p in places.values())
                block += cut
                rows += [row] * len(cut)
                if len(block) >= STRETCH:
                    yield _columns(schema, batch.column(0).take(pa.array(rows, pa.int64())), first, more, block)
                    rows, first, more, block = [], [], [], []
        if block:
            yield _columns(schema, batch.column(0).take(pa.array(rows, pa.int64())), first, more, block)


def _columns(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _firsts(batches: Iterator[pa.RecordBatch], copies: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted blocks with the first place of their equal.  What the next batch needs is the last block, the first place of its run and how many places were seen."""
    last, seen = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, place, more, block = batch.columns
        new = np.ones(n, bool)
        new[1:] = pc.not_equal(block[1:], block[:-1]).to_numpy(zero_copy_only=False)
        if last is not None:
            new[0] = block[0].as_py() != last[2].as_py()
        run = np.maximum.accumulate(np.where(new, np.arange(1, n + 1), 0))  # 0: the run of the last batch
        firsts = [pa.concat_arrays([pa.array([last[k] if last else None], c.type), c]).take(pa.array(run)) for k, c in enumerate((key, place))]
        counts = pc.fill_null(pc.list_value_length(more), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        at = np.repeat(np.arange(n), counts)
        head = np.zeros(len(at), bool)
        head[np.cumsum(counts) - counts] = True
        places = np.empty(len(at), np.int32)
        places[head], places[~head] = place.to_numpy(), more.flatten().to_numpy(zero_copy_only=False)
        is_first = head & new[at]
        start = np.maximum.accumulate(np.where(is_first, np.arange(len(at)), -seen))
        rank = np.arange(len(at)) - start - 1  # -1: the first place
        last, seen = (firsts[0][-1].as_py(), firsts[1][-1].as_py(), block[n - 1]), int(len(at) - start[-1])
        pick = np.flatnonzero(~is_first) if copies else np.arange(len(at))
        rows = pa.array(at[pick])
        yield _columns(schema, key.take(rows), pa.array(places[pick]), *(c.take(rows) for c in firsts), pa.array((rank // SHARE)[pick].astype(np.int32)), block.take(pa.array(at[pick], mask=rank[pick] % SHARE > 0)))


def first_blocks(df: DataFrame, size: int, id_col: str = "doc_id", col: str = "text", copies: bool = False) -> DataFrame:
    """(id, block_no, first_id, first_block_no, share, block): each block of `size` bytes with the first place, by (id, block_no), of its equal.  Its copies come in shares of at most 256, and the bytes stand at one copy of a share.

    Blocks are sorted once and looked at in turn, so they cross one shuffle, and a block that is everywhere takes no memory; repeats in a row go together.  copies: without the first places.
    """
    bound_batches(df)
    src = df.select(id_col, F.encode(F.col(col).cast("string"), "UTF-8").alias("x"))
    key = src.schema[id_col].dataType.simpleString()
    places = StructType.fromDDL(f"id {key}, block_no int, more array<int>, block binary")
    b = src.mapInArrow(partial(_distinct, size=size, schema=to_arrow_schema(places)), places).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("id"), "block_no")
    out = StructType.fromDDL(f"`{id_col}` {key}, block_no int, `first_{id_col}` {key}, first_block_no int, share int, block binary")
    return b.mapInArrow(partial(_firsts, copies=copies, schema=to_arrow_schema(out)), out)


def _handed_on(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(id, part): blocks handed on to the rows after theirs, which name the same first place and share."""
    last = None
    for batch in batches:
        if batch.num_rows:
            key, place, block = batch.columns[0], batch.columns[1], batch.columns[-1]
            block = pc.fill_null_forward(pa.concat_arrays([pa.array([last], block.type), block]))[1:]
            last = block[-1].as_py()
            yield _columns(schema, key, pa.StructArray.from_arrays([place, block], fields=[*schema.field(1).type]))


def _restored(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Values from what a row keeps and its copies' blocks."""
    for batch in batches:
        values = []
        for x, parts in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
            x = K.as_bytes(x.as_buffer() if x.is_valid else None)
            if parts.is_valid:
                places, block = (parts.values.field(k) for k in range(2))
                order = pc.sort_indices(places)
                places = places.take(order).to_numpy()
                x = K.fill_blocks(K.cut_blocks(x, places, size), places, buffers(block.take(order))[0], size)
            values.append(x.tobytes())
        yield _columns(schema, *batch.columns[:-2], values)


def restore(df: DataFrame, copies: DataFrame, size: int, id_col: str, col: str = "text") -> DataFrame:
    """All columns but `col`, and `value`: bytes restored from the blocks that stand somewhere first and the index of the others.

    df: its ids have one row each; copies: `first_blocks` of it without the first places.  A row keeps its bytes but for its copies' blocks.  Those stand once for each share of the copies, and meet the index by first place and share, so that a block that is everywhere is not one task's; only they move, as the rows do once.
    """
    bound_batches(df)
    first = [f"first_{id_col}", "first_block_no", "share"]
    met = copies.repartition(*first).sortWithinPartitions(*first, F.asc_nulls_last("block"))
    part = StructType.fromDDL(f"_id {copies.schema[id_col].dataType.simpleString()}, part struct<block_no: int, block: binary>")
    parts = met.mapInArrow(partial(_handed_on, schema=to_arrow_schema(part)), part)
    parts = parts.repartition("_id").groupBy("_id").agg(F.collect_list("part").alias("_parts"))
    rest = [c for c in df.columns if c != col]
    got = df.join(parts, df[id_col] == parts["_id"], "left").select(*rest, F.encode(F.col(col).cast("string"), "UTF-8").alias("_x"), "_parts")
    out = StructType([*(got.schema[c] for c in rest), *StructType.fromDDL("value binary").fields])
    return got.mapInArrow(partial(_restored, size=size, schema=to_arrow_schema(out)), out)


def shifted(values: Column) -> Column:
    """An array one place on, from 0: what `lag` is to rows, without exploding them."""
    return F.concat(F.array(F.lit(0).cast("long")), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))))


def bits_of(df: DataFrame) -> DataFrame:
    return df.select("vec_id", F.transform("embedding", lambda x: float_bits(x)).alias("u"))


def _commas(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def _arith(df: DataFrame) -> DataFrame:
    d = bits_of(df).select("vec_id", F.transform(F.arrays_zip(F.col("u").alias("a"), shifted(F.col("u")).alias("b")), lambda z: F.pmod(z["a"] - z["b"], F.lit(1 << 32))).alias("d"), F.transform(F.arrays_zip(F.col("u").alias("a"), shifted(F.col("u")).alias("b")), lambda z: z["a"].bitwiseXOR(z["b"])).alias("x"))
    return d.select("vec_id", F.md5(_commas(F.col("d"))).alias("delta_md5"), F.md5(_commas(F.col("x"))).alias("xor_md5"))


def _zigzag(df: DataFrame) -> DataFrame:
    z = bits_of(df).select("vec_id", F.transform(F.arrays_zip(F.col("u").alias("a"), shifted(F.col("u")).alias("b")), lambda p: zigzag(wrap32(p["a"] - p["b"]))).alias("z"))
    return z.select("vec_id", F.aggregate("z", F.lit(0).cast("long"), lambda a, v: a + varint_len(v)).alias("n_bytes"), F.array_max("z").alias("largest"))


def _axes(df: DataFrame) -> DataFrame:
    """Interleaved x, y, z apart, as differences."""
    every_third = lambda a: F.filter("embedding", lambda x, i: i % 3 == a)
    rows = df.select("vec_id", F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), every_third(a).alias("v")) for a in range(3)))).alias("p")).select("vec_id", "p.axis", F.transform("p.v", lambda x: x.cast("double")).alias("v"))
    step = F.transform(F.arrays_zip(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))).alias("a"), F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))).alias("b")), lambda z: F.abs(z["a"] - z["b"]))
    return rows.select("vec_id", "axis", F.size("v").cast("long").alias("n"), F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.aggregate(step, F.lit(0.0), lambda a, s: a + s), 6).alias("path"))


def _rle_sizes(x: np.ndarray) -> tuple:
    d = K.delta(x)
    v, n = K.runs(d, 65535)
    zero, run = K.rle_zero(d), K.rle(d)
    return len(zero), md5(zero), len(run), md5(run), int(np.where((v == 0) & (n >= 4), 4, n).sum())


def _bwt(x: np.ndarray) -> tuple:
    last, primary = K.bwt(x)
    lf = np.empty(len(last), np.int64)
    lf[np.argsort(last, kind="stable")] = np.arange(len(last))
    return len(x), primary, md5(last), int((lf * (np.arange(len(last)) + 1)).sum()), md5(K.unbwt(last, primary))


def _block_restore(s, d, size=64):
    """Rows have keys of their own, as ids may be null or repeat."""
    docs = table(s, d, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    value = restore(docs, first_blocks(docs, size, "row", copies=True), size, "row")
    return value.select("doc_id", F.octet_length("value").cast("long").alias("n"), F.md5("value").alias("md5")).where("n > 0")


QUERIES = {
    "q_delta": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", delta_md5=K.delta),
    "q_delta_inverse": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", prefix_md5=K.undelta, back_md5=lambda x: K.undelta(K.delta(x))),
    "q_xor_delta": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", xor_md5=K.xor_blocks, prefix_md5=K.unxor_blocks, back_md5=lambda x: K.unxor_blocks(K.xor_blocks(x))),
    "q_rle": lambda s, d: map_bytes(spread(table(s, d, "documents").select("doc_id", "text")), "text", _rle_sizes, "zero_bytes long, zero_md5 string, run_bytes long, run_md5 string, tag_bytes long", ["doc_id"]),
    "q_plane_transpose": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", planes_md5=lambda x: K.to_planes(x, 4)[0], natural_md5=lambda x: K.to_planes(x, 4, reverse=False)[0], back_md5=lambda x: K.from_planes(*K.to_planes(x, 4)[:1], 4, K.to_planes(x, 4)[1])),
    "q_mask_and_shuffle": lambda s, d: map_bytes(table(s, d, "documents"), "text", lambda x: tuple(v for y, p in (mask_and_shuffle(x, 2, 1, "pcm"),) for v in (len(x), p, md5(y))), "n long, pad int, md5 string", ["doc_id"]),
    "q_bitplane64": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", planes_md5=K.bit_planes, back_md5=lambda x: K.unbit_planes(K.bit_planes(x))),
    "q_mask_pcm": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", level1_md5=lambda x: K.mask_pcm(x, 1), level2_md5=lambda x: K.mask_pcm(x, 2)),
    "q_mask_pixels": lambda s, d: transform_digest(table(s, d, "documents"), "doc_id", "text", level1_md5=lambda x: K.mask_pixels(x, 1), level2_md5=lambda x: K.mask_pixels(x, 2)),
    "q_chunk": lambda s, d: blocks(table(s, d, "documents"), 4096).select("doc_id", "block_no", F.octet_length("block").cast("long").alias("n"), F.md5("block").alias("md5")),
    "q_block_dedup": lambda s, d: first_blocks(table(s, d, "documents"), 64).select("doc_id", "block_no", "first_doc_id", "first_block_no", (~((F.col("doc_id") == F.col("first_doc_id")) & (F.col("block_no") == F.col("first_block_no")))).alias("duplicate")),
    "q_dedup_stats": lambda s, d: blocks(table(s, d, "documents"), 64).groupBy("block").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_blocks"), F.count("*").alias("n_unique"), F.sum(F.col("n") - 1).alias("n_dups")),
    "q_block_restore": _block_restore,
    "q_u32_delta": lambda s, d: _arith(table(s, d, "embeddings")),
    "q_zigzag_varint": lambda s, d: _zigzag(table(s, d, "embeddings")),
    "q_float_ordinal": lambda s, d: bits_of(table(s, d, "embeddings")).select("vec_id", F.posexplode("u").alias("i", "u")).select("vec_id", F.col("i").cast("long").alias("i"), ordinal(F.col("u")).alias("ordinal"), from_ordinal(ordinal(F.col("u"))).alias("back")),
    "q_deinterleave3": lambda s, d: _axes(table(s, d, "embeddings")),
    "q_bwt": lambda s, d: map_bytes(table(s, d, "benchmark"), "text", _bwt, "n long, primary_index int, last_md5 string, lf_sum long, back_md5 string", ["item_id"]),
    "q_mtf": lambda s, d: transform_digest(table(s, d, "benchmark"), "item_id", "text", mtf_md5=K.mtf, back_md5=lambda x: K.unmtf(K.mtf(x))),
    "q_padding": lambda s, d: table(s, d, "documents").select("doc_id", *(padding(F.octet_length("text").cast("long"), k).alias(f"pad{k}") for k in (2, 3, 4, 4096))),
}


def _digest(y: str, table: str = "b", order: str = "pos", key: str = "doc_id") -> str:
    return f"md5(coalesce(unhex(string_agg(format('{{:02X}}', CAST({y} AS INTEGER)), '' ORDER BY {order}) FILTER (WHERE {y} IS NOT NULL)), ''::BLOB))"


_DELTA = "d AS (SELECT doc_id, pos, (b - lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) + 256) % 256 AS b FROM b)"
_N = "n AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, md5(encode(coalesce(text, ''))) AS m FROM documents)"
_RUNS = """i AS (SELECT doc_id, pos, b, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - row_number() OVER (PARTITION BY doc_id, b ORDER BY pos) AS g FROM d),
k AS (SELECT doc_id, pos, b, g, row_number() OVER (PARTITION BY doc_id, b, g ORDER BY pos) - 1 AS r FROM i),
r AS (SELECT doc_id, b, min(pos) AS pos, count(*) AS len FROM k GROUP BY doc_id, b, g, r // 255), w AS (SELECT doc_id, b, min(pos) AS pos, count(*) AS len FROM k GROUP BY doc_id, b, g)"""
ORACLE_SQL = {
    "q_delta": f"WITH {BYTES}, {_DELTA}, {_N} SELECT doc_id, any_value(n) AS n, {_digest('b')} AS delta_md5 FROM n LEFT JOIN d USING (doc_id) GROUP BY doc_id",
    "q_delta_inverse": f"WITH {BYTES}, {_N}, s AS (SELECT doc_id, pos, sum(b) OVER (PARTITION BY doc_id ORDER BY pos) % 256 AS y FROM b) SELECT doc_id, any_value(n) AS n, {_digest('y')} AS prefix_md5, any_value(m) AS back_md5 FROM n LEFT JOIN s USING (doc_id) GROUP BY doc_id",
    "q_xor_delta": f"""WITH {BYTES}, {_N}, s AS (SELECT doc_id, pos, CASE WHEN pos % 64 > 0 AND pos < n // 64 * 64 THEN xor(b, lag(b) OVER (PARTITION BY doc_id ORDER BY pos)) ELSE b END AS y,
CASE WHEN pos < n // 64 * 64 THEN bit_xor(b) OVER (PARTITION BY doc_id, pos // 64 ORDER BY pos) ELSE b END AS z FROM b JOIN n USING (doc_id))
SELECT doc_id, any_value(n) AS n, {_digest('y')} AS xor_md5, {_digest('z')} AS prefix_md5, any_value(m) AS back_md5 FROM n LEFT JOIN s USING (doc_id) GROUP BY doc_id""",
    "q_rle": f"""WITH {BYTES}, {_DELTA}, {_RUNS},
z AS (SELECT doc_id, pos, CASE WHEN b = 0 THEN '00' || format('{{:02X}}', len) ELSE repeat(format('{{:02X}}', CAST(b AS INTEGER)), len) END AS h,
 CASE WHEN len >= 4 THEN '00' || format('{{:02X}}', len) || format('{{:02X}}', CAST(b AS INTEGER)) WHEN b = 0 THEN repeat('000100', len) ELSE repeat(format('{{:02X}}', CAST(b AS INTEGER)), len) END AS g FROM r),
a AS (SELECT doc_id, string_agg(h, '' ORDER BY pos) AS h, string_agg(g, '' ORDER BY pos) AS g FROM z GROUP BY doc_id), t AS (SELECT doc_id, sum(CASE WHEN b = 0 AND len >= 4 THEN 4 * ((len + 65534) // 65535) ELSE len END) AS t FROM w GROUP BY doc_id)
SELECT doc_id, CAST(length(coalesce(h, '')) // 2 AS BIGINT) AS zero_bytes, md5(unhex(coalesce(h, ''))) AS zero_md5, CAST(length(coalesce(g, '')) // 2 AS BIGINT) AS run_bytes, md5(unhex(coalesce(g, ''))) AS run_md5, CAST(coalesce(t, 0) AS BIGINT) AS tag_bytes
FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "q_plane_transpose": f"""WITH {BYTES}, {_N}, x AS (SELECT doc_id, pos, b FROM b UNION ALL SELECT doc_id, unnest(range(n, (n + 3) // 4 * 4)), 0 FROM n), y AS (SELECT doc_id, (3 - pos % 4) * 1000000000 + pos // 4 AS q, pos % 4 * 1000000000 + pos // 4 AS r, b FROM x)
SELECT doc_id, any_value(n) AS n, {_digest('b', order='q')} AS planes_md5, {_digest('b', order='r')} AS natural_md5, any_value(m) AS back_md5 FROM n LEFT JOIN y USING (doc_id) GROUP BY doc_id""",
    "q_mask_and_shuffle": f"""WITH {BYTES}, {_N}, x AS (SELECT doc_id, pos, CASE WHEN pos >= 44 AND pos % 2 = 0 THEN b & 240 ELSE b END AS b FROM b UNION ALL SELECT doc_id, n, 0 FROM n WHERE n % 2 = 1),
y AS (SELECT doc_id, (1 - pos % 2) * 1000000000 + pos // 2 AS q, CASE WHEN n >= 7 THEN (b - lag(b, 1, 0) OVER (PARTITION BY doc_id, pos % 2 ORDER BY pos) + 256) % 256 ELSE b END AS y FROM x JOIN n USING (doc_id))
SELECT doc_id, any_value(n) AS n, CAST(any_value(n % 2) AS INTEGER) AS pad, {_digest('y', order='q')} AS md5 FROM n LEFT JOIN y USING (doc_id) GROUP BY doc_id""",
    "q_bitplane64": f"""WITH {BYTES}, {_N}, g AS (SELECT doc_id, pos // 64 AS blk, pos % 64 // 8 AS j, [{', '.join(f'sum(((b >> {k}) & 1) << CAST(pos % 8 AS INTEGER))' for k in range(8))}] AS v FROM b JOIN n USING (doc_id) WHERE pos < n // 64 * 64 GROUP BY ALL),
u AS (SELECT doc_id, blk, j, unnest(range(8)) AS k, CAST(unnest(v) AS INTEGER) AS v FROM g),
y AS (SELECT doc_id, blk * 64 + k * 8 + j AS pos, CASE WHEN j > 0 THEN xor(v, lag(v) OVER (PARTITION BY doc_id, blk, k ORDER BY j)) ELSE v END AS y FROM u UNION ALL SELECT doc_id, pos, b FROM b JOIN n USING (doc_id) WHERE pos >= n // 64 * 64)
SELECT doc_id, any_value(n) AS n, {_digest('y')} AS planes_md5, any_value(m) AS back_md5 FROM n LEFT JOIN y USING (doc_id) GROUP BY doc_id""",
    "q_mask_pcm": f"WITH {BYTES}, {_N}, x AS (SELECT doc_id, pos, CASE WHEN pos >= 44 AND pos % 2 = 0 THEN b & 240 ELSE b END AS y, CASE WHEN pos >= 44 AND pos % 2 = 0 THEN 0 ELSE b END AS z FROM b) SELECT doc_id, any_value(n) AS n, {_digest('y')} AS level1_md5, {_digest('z')} AS level2_md5 FROM n LEFT JOIN x USING (doc_id) GROUP BY doc_id",
    "q_mask_pixels": f"WITH {BYTES}, {_N}, x AS (SELECT doc_id, pos, CASE WHEN pos >= 54 THEN b & 248 ELSE b END AS y, CASE WHEN pos >= 54 THEN b & 240 ELSE b END AS z FROM b) SELECT doc_id, any_value(n) AS n, {_digest('y')} AS level1_md5, {_digest('z')} AS level2_md5 FROM n LEFT JOIN x USING (doc_id) GROUP BY doc_id",
    "q_chunk": "WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), c AS (SELECT doc_id, unnest(range((length(h) + 8191) // 8192)) AS k, h FROM h) SELECT doc_id, CAST(k AS INTEGER) AS block_no, CAST(length(substr(h, k * 8192 + 1, 8192)) // 2 AS BIGINT) AS n, md5(unhex(substr(h, k * 8192 + 1, 8192))) AS md5 FROM c",
    "q_block_dedup": "WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '.{1,128}') AS l FROM documents), c AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS block_no, unnest(l) AS h FROM h), m AS (SELECT doc_id, block_no, first_value(doc_id) OVER w AS first_doc_id, first_value(block_no) OVER w AS first_block_no FROM c WINDOW w AS (PARTITION BY h ORDER BY doc_id, block_no)) SELECT *, NOT (doc_id = first_doc_id AND block_no = first_block_no) AS duplicate FROM m",
    "q_dedup_stats": "WITH c AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '.{1,128}')) AS h FROM documents) SELECT count(*) AS n_blocks, count(DISTINCT h) AS n_unique, count(*) - count(DISTINCT h) AS n_dups FROM c",
    "q_block_restore": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n, md5(encode(text)) AS md5 FROM documents WHERE text <> ''",
    "q_u32_delta": f"WITH {FLOATS}, l AS (SELECT vec_id, i, CAST(u AS BIGINT) AS u, CAST(lag(u, 1, 0) OVER (PARTITION BY vec_id ORDER BY i) AS BIGINT) AS v FROM f) SELECT vec_id, md5(string_agg(CAST((u - v + 4294967296) % 4294967296 AS VARCHAR), ',' ORDER BY i)) AS delta_md5, md5(string_agg(CAST(xor(u, v) AS VARCHAR), ',' ORDER BY i)) AS xor_md5 FROM l GROUP BY vec_id",
    "q_zigzag_varint": f"""WITH {FLOATS}, l AS (SELECT vec_id, (u - lag(u, 1, 0) OVER (PARTITION BY vec_id ORDER BY i) + 4294967296) % 4294967296 AS w FROM f), z AS (SELECT vec_id, CASE WHEN w >= 2147483648 THEN -2 * (w - 4294967296) - 1 ELSE 2 * w END AS z FROM l)
SELECT vec_id, CAST(sum(CASE WHEN z < 128 THEN 1 WHEN z < 16384 THEN 2 WHEN z < 2097152 THEN 3 WHEN z < 268435456 THEN 4 ELSE 5 END) AS BIGINT) AS n_bytes, CAST(max(z) AS BIGINT) AS largest FROM z GROUP BY vec_id""",
    "q_float_ordinal": f"WITH {FLOATS} SELECT vec_id, i, CAST(CASE WHEN u >= 2147483648 THEN 2147483648 - u ELSE u END AS BIGINT) AS ordinal, CAST(CASE WHEN u = 2147483648 THEN 0 ELSE u END AS BIGINT) AS back FROM f",
    "q_deinterleave3": f"WITH {FLOATS}, l AS (SELECT vec_id, CAST(i % 3 AS INTEGER) AS axis, i, x, abs(x - lag(x) OVER (PARTITION BY vec_id, i % 3 ORDER BY i)) AS d FROM f) SELECT vec_id, axis, count(*) AS n, round(arg_min(x, i), 6) AS first, round(coalesce(sum(d), 0), 6) AS path FROM l GROUP BY vec_id, axis",
    "q_bwt": """WITH h AS (SELECT item_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n, md5(encode(coalesce(text, ''))) AS m FROM benchmark), r AS (SELECT item_id, i, n, substr(h, 2 * i + 1) || substr(h, 1, 2 * i) AS rot, substr(h, 2 * ((i + n - 1) % n) + 1, 2) AS last FROM (SELECT *, unnest(range(n)) AS i FROM h)),
o AS (SELECT item_id, i, last, row_number() OVER (PARTITION BY item_id ORDER BY rot, i) - 1 AS k FROM r), l AS (SELECT item_id, i, last, k, row_number() OVER (PARTITION BY item_id ORDER BY last, k) - 1 AS lf FROM o)
SELECT item_id, CAST(any_value(n) AS BIGINT) AS n, CAST(max(CASE WHEN i = 0 THEN k END) AS INTEGER) AS primary_index, md5(unhex(string_agg(last, '' ORDER BY k))) AS last_md5, CAST(sum(lf * (k + 1)) AS BIGINT) AS lf_sum, any_value(m) AS back_md5 FROM l JOIN h USING (item_id) GROUP BY item_id""",
    "q_mtf": f"""WITH {BYTES.replace('doc_id', 'item_id').replace('documents', 'benchmark')}, p AS (SELECT item_id, pos, b, lag(pos) OVER (PARTITION BY item_id, b ORDER BY pos) AS prev FROM b),
y AS (SELECT a.item_id, a.pos, CASE WHEN a.prev IS NOT NULL THEN count(DISTINCT CASE WHEN c.pos > a.prev THEN c.b END) ELSE a.b + count(DISTINCT CASE WHEN c.b > a.b THEN c.b END) END AS y FROM p a LEFT JOIN p c ON a.item_id = c.item_id AND c.pos < a.pos GROUP BY a.item_id, a.pos, a.prev, a.b)
SELECT item_id, CAST(octet_length(encode(any_value(text))) AS BIGINT) AS n, {_digest('y')} AS mtf_md5, md5(encode(any_value(text))) AS back_md5 FROM benchmark LEFT JOIN y USING (item_id) GROUP BY item_id""",
    "q_padding": "SELECT doc_id, " + ", ".join(f"CAST(({k} - octet_length(encode(text)) % {k}) % {k} AS BIGINT) AS pad{k}" for k in (2, 3, 4, 4096)) + " FROM documents",
}
