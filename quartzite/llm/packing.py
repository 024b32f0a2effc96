"""Best-fit packing of token sequences into rows of a fixed capacity, in bulk-synchronous rounds.

Pieces go by size class, the largest first.  A round range-sorts the pieces of its class and the gaps that could take one, by
size; every partition sweeps its range, giving each piece, the largest first, the smallest gap that takes it (the successor of its
size).  Pieces of one size want the same gap: the conflict goes by rank, the r-th piece gets the r-th of the equal gaps.  The
partitions' ends, pieces that found no gap in their range and gaps that found no piece, are carried into one more sweep; what no gap
takes there opens new rows.  The gaps are updated, and the next round begins.

Sizes are whole numbers up to the capacity, so pieces of one size and equal gaps of neighbouring rows stay grouped as runs: (size,
first rank, number) and (gap, first row, number).  These tables are bounded by the capacity and not by the data, whose pieces
stay where they are: they get their rank within their size from counts per partition, which no frequent size can skew, and find
their place by a join with the runs that were placed.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quartzite.llm.common import arrow_batches, drop, materialize, new_path
from quartzite.llm.tokens import encoded, vocabulary

CAPACITY, END_ID = 2048, 0
#: Runs that a task sweeps in the parallel part of a round; placed runs that are broadcast at most.
PART_RUNS, SENT_RUNS = 256, 1 << 20
#: Kinds of runs: pieces to be placed, gaps, placed pieces, and one row with the number of rows opened.
PIECE, GAP, PLACED, ROWS = range(4)
RUNS = "kind int, size long, at long, n long, row long, offset long"


def best_fit(pieces: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]], capacity: int, rows: int | None) -> tuple[list, list, list, int | None]:
    """Sweep runs of pieces (size, first rank, n) over runs of gaps (gap, first row, n), the largest piece first.

    Gives placed runs (size, first rank, n, first row, offset), the pieces left, the gaps left and `rows`, the number of rows opened;
    where it is None, no row is opened.
    """
    placed, left_over = [], []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first row, n)
    sizes: list[int] = []  # of gaps, ascending

    def leave(gap: int, row: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                bisect.insort(sizes, gap)
            runs[gap].append((row, n))

    for gap in sorted(gaps, reverse=True):
        leave(*gap)
    for size, rank, left in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while left and (at := bisect.bisect_left(sizes, size)) < len(sizes):
            gap = sizes[at]
            row, n = runs[gap].pop()
            if not runs[gap]:
                del runs[gap]
                sizes.pop(at)
            take = min(n, left)
            placed.append((size, rank, take, row, capacity - gap))
            leave(gap - size, row, take)
            leave(gap, row + take, n - take)
            rank, left = rank + take, left - take
        if not left:
            continue
        if rows is None:
            left_over.append((size, rank, left))
            continue
        per = capacity // size
        full, rest = divmod(left, per)
        for j in range(per):
            n = full + (j < rest)
            if not n:
                break
            placed.append((size, rank, n, rows, j * size))
            rank += n
        leave(capacity - per * size, rows, full)
        if rest:
            leave(capacity - rest * size, rows + full, 1)
        rows += full + bool(rest)
    return placed, left_over, [(gap, row, n) for gap in sizes for row, n in runs[gap]], rows


def _sweep(batches: Iterator[pa.RecordBatch], capacity: int, opens: bool) -> Iterator[pa.RecordBatch]:
    """The runs of one partition, or the carried ends of all."""
    cols = [np.concatenate(c) for c in zip(*([x.to_numpy(zero_copy_only=False) for x in b.columns] for b in batches), strict=True)]
    if not cols:
        return
    kind, size, at, n, row, _ = cols
    of = lambda k, *c: [tuple(int(x) for x in r) for r in zip(*(x[kind == k] for x in c), strict=True)]
    rows = int(n[kind == ROWS].sum()) if opens else None
    placed, left, gaps, rows = best_fit(of(PIECE, size, at, n), of(GAP, size, row, n), capacity, rows)
    out = [(PLACED, *p) for p in placed] + [(PIECE, *p, 0, 0) for p in left] + [(GAP, g, 0, m, r, 0) for g, r, m in gaps]
    out += [(ROWS, 0, 0, rows, 0, 0)] if opens else [(ROWS, 0, 0, int(x), 0, 0) for x in n[kind == ROWS]]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(zip(*out, strict=True))], [x.split()[0] for x in RUNS.split(", ")])


def rounds(counts: DataFrame, capacity: int) -> DataFrame:
    """Place `counts` (size, n): runs (size, at, n, row, offset) of pieces by rank, `n` pieces of ranks from `at` on in rows from `row` on."""
    spark = counts.sparkSession
    paths = [new_path(spark, "runs")]
    first = spark.range(1).select(F.lit(ROWS).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("size", "at", "n", "row", "offset")))
    pieces = counts.select(F.lit(PIECE).alias("kind"), F.col("size").cast("long"), F.lit(0).cast("long").alias("at"), F.col("n").cast("long"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("offset"))
    state = materialize(first.unionByName(pieces), "runs", paths[0])
    high = capacity
    while high:
        low = high // 2 if high > capacity // 32 else 0
        mine = ((F.col("kind") == PIECE) & F.col("size").between(low + 1, high)) | ((F.col("kind") == GAP) & (F.col("size") > low))
        n = {r.kind: r.c for r in state.where(mine).groupBy("kind").agg(F.count("*").alias("c")).collect()}
        high = low
        if not n.get(PIECE):
            continue
        for parts in sorted({-(-sum(n.values()) // PART_RUNS), 1} if n.get(GAP) else {1}, reverse=True):
            go = state.where(mine | (F.col("kind") == ROWS))
            sorted_ = go.repartitionByRange(parts, F.desc("size"), "kind", "row", "at") if parts > 1 else go.coalesce(1)
            swept = sorted_.mapInArrow(partial(_sweep, capacity=capacity, opens=parts == 1), RUNS)
            paths.append(new_path(spark, "runs"))
            state = materialize(swept.unionByName(state.where(~mine & (F.col("kind") != ROWS))), "runs", paths[-1])
    drop(spark, *paths[:-1])
    return state.where(F.col("kind") == PLACED).drop("kind")


def _rank(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """Append the partition, and each row's number among the partition's rows of its size."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        sizes = batch.column(place).to_numpy(zero_copy_only=False)
        order = np.argsort(sizes, kind="stable")
        kinds, first, n = np.unique(sizes[order], return_index=True, return_counts=True)
        rank = np.empty(len(sizes), np.int64)
        rank[order] = np.arange(len(sizes)) - np.repeat(first, n) + np.repeat([seen.get(k, 0) for k in kinds.tolist()], n)
        for k, c in zip(kinds.tolist(), n.tolist(), strict=True):
            seen[k] = seen.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(sizes), part)), pa.array(rank)], [*batch.schema.names, "_part", "_rank"])


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """`pieces` with sequence_id and offset (longs): which row of `capacity` each goes to, and where, gapless from 0.

    Lengths must be between 1 and `capacity` (a null or another length is an error); ties and repeated rows are pieces of their own,
    an empty table stays empty.  Other columns pass through, of any type; input columns sequence_id and offset are replaced.
    """
    spark = pieces.sparkSession
    names = {c: f"c{i}" for i, c in enumerate(pieces.columns) if c not in ("sequence_id", "offset")}
    src = pieces.select(*(F.col(c).alias(n) for c, n in names.items()), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_size"))
    schema = StructType([*src.schema.fields, StructField("_part", LongType()), StructField("_rank", LongType())])
    ranked = materialize(src.mapInArrow(partial(_rank, place=len(names)), schema), "pieces")
    per = ranked.groupBy("_part", "_size").agg(F.count("*").alias("_n"))
    wrong = ranked.agg(F.min("_size").alias("lo"), F.max("_size").alias("hi")).first()
    if wrong.lo is not None and not 0 < wrong.lo <= wrong.hi <= capacity:
        raise ValueError(f"lengths must be between 1 and {capacity}")
    before = per.withColumn("_base", F.sum("_n").over(Window.partitionBy("_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(F.col("_part").alias("_p"), F.col("_size").alias("_s"), F.coalesce("_base", F.lit(0)).alias("_base"))
    plan = rounds(per.groupBy(F.col("_size").alias("size")).agg(F.sum("_n").alias("n")), capacity).select("size", "at", "n", "row", "offset")
    # the plan is bounded by the capacity, a few runs for each size; for a very large capacity Spark chooses the join
    plan = F.broadcast(plan) if plan.count() <= SENT_RUNS else plan
    placed = ranked.join(before, (F.col("_part") == F.col("_p")) & (F.col("_size") == F.col("_s"))).withColumn("_at", F.col("_base") + F.col("_rank"))
    placed = placed.join(plan, (F.col("_size") == F.col("size")) & (F.col("_at") >= F.col("at")) & (F.col("_at") < F.col("at") + F.col("n")))
    return placed.select(*(F.col(n).alias(c) for c, n in names.items()), (F.col("row") + F.col("_at") - F.col("at")).alias("sequence_id"), F.col("offset"))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(parts: Iterable[np.ndarray], capacity: int) -> Iterator[np.ndarray]:
    """The ids of `parts` and a final END_ID in pieces of `capacity`, the last may be shorter."""
    held = np.zeros(0, "<u4")
    for ids in chain(parts, (np.array([END_ID]),)):
        held = np.concatenate([held, ids.astype("<u4")])
        full = len(held) // capacity * capacity
        for at in range(0, full, capacity):
            yield held[at : at + capacity]
        held = held[full:]
    if len(held):
        yield held


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    names, types = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    width_ = 6 if keep_ids else 5
    for batch in batches:
        for i, docs in encoded(batch.column(1), path):
            out: list[list] = [[] for _ in range(6)]
            own = batch.column(0).slice(i, len(docs)).to_pylist()
            for doc, parts in zip(own, docs, strict=True):
                for k, ids in enumerate(_cut(parts, capacity)):
                    part = ids.tobytes()
                    for c, v in zip(out, (doc, k, k * capacity, len(ids), zlib.crc32(part), part if keep_ids else None), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:width_], types[:width_], strict=True)], names[:width_])


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and a final 0, cut into pieces of `capacity` only where longer.  Null and empty texts are the 0 alone.

    keep_ids: with the pieces' ids as little-endian unsigned 32-bit numbers, as training files hold them.
    """
    arrow_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return src.mapInArrow(partial(_pieces, path=vocab or vocabulary(), capacity=capacity, keep_ids=keep_ids), PIECES + ", ids binary" * keep_ids)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """`token_pieces` of `docs`, packed.  The pieces are written first: tokenizers and ranks then share the same Python workers, one after the other.

    Null ids and repeated rows are documents of their own, null and empty texts are the end token alone, very long texts are cut into
    pieces of `capacity`, an empty table gives no piece, other columns are left out.
    """
    path = new_path(docs.sparkSession, "tokens")
    out = pack(materialize(token_pieces(docs, id_col, text_col, vocab, capacity, keep_ids), "tokens", path), "length", capacity)
    drop(docs.sparkSession, path)
    return out


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
