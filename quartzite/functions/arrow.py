"""Row functions on bytes, run over Arrow batches without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quartzite.functions.kernels import as_bytes


def bound_batches(df: DataFrame, rows: int = 2000) -> None:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores: few large files are few tasks, which costs more than a shuffle of the rows where a function is slow."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary or string column; null counts as empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offs = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off is not None and off.size else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _run_batch(batches: Iterator[pa.RecordBatch], fn: Callable, schema: pa.Schema, kept: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = fn(*buffers(batch.column(batch.num_columns - 1)))
        keep = [c.cast(schema.field(k).type) for k, c in enumerate(batch.columns[:kept])]
        yield pa.RecordBatch.from_arrays(keep + [pa.array(x, schema.field(kept + k).type) for k, x in enumerate(got)], schema=schema)


def map_batches(df: DataFrame, col: str, fn: Callable[[np.ndarray, np.ndarray], tuple], out: str, keep: Sequence[str]) -> DataFrame:
    """As `map_bytes`, but `fn` gets the bytes of a whole batch and its rows' offsets, and gives an array for each column of `out`."""
    bound_batches(df)
    kind = dict(df.dtypes)[col]
    src = df.select(*keep, (F.col(col) if kind == "binary" else F.encode(F.col(col).cast("string"), "UTF-8")).alias("_blob"))
    added = StructType.fromDDL(out)
    schema = StructType([*(src.schema[c] for c in keep), *added.fields])
    return src.mapInArrow(partial(_run_batch, fn=fn, schema=to_arrow_schema(schema), kept=len(keep)), schema)


def _run(batches: Iterator[pa.RecordBatch], fn: Callable, schema: pa.Schema, kept: int, many: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = batch.column(batch.num_columns - 1)
        results, rows = [], []
        for i in range(batch.num_rows):
            x = blobs[i]
            got = fn(as_bytes(x.as_buffer() if x.is_valid else None) if not isinstance(x, pa.ListScalar) else x.as_py())
            for r in got if many else (got,):
                results.append(r if isinstance(r, tuple) else (r,))
                rows.append(i)
        keep = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:kept]]
        new = [pa.array([r[k] for r in results], schema.field(kept + k).type) for k in range(len(schema) - kept)]
        yield pa.RecordBatch.from_arrays([c.cast(schema.field(k).type) for k, c in enumerate(keep)] + new, schema=schema)


def map_bytes(df: DataFrame, col: str, fn: Callable[[np.ndarray], tuple], out: str, keep: Sequence[str], many: bool = False) -> DataFrame:
    """`keep` and the columns `out` of `fn`, called on the bytes of each row's `col` (strings as UTF-8, null as empty).

    many: `fn` yields any number of rows.  Arrays are handed over as lists.
    """
    bound_batches(df)
    kind = dict(df.dtypes)[col]
    blob = F.col(col) if kind.startswith("array") or kind == "binary" else F.encode(F.col(col).cast("string"), "UTF-8")
    src = df.select(*keep, blob.alias("_blob"))
    added = StructType.fromDDL(out)
    schema = StructType([*(src.schema[c] for c in keep), *added.fields])
    return src.mapInArrow(partial(_run, fn=fn, schema=to_arrow_schema(schema), kept=len(keep), many=many), schema)
