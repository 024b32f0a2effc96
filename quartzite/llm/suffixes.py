"""Repeated passages by a sparse suffix array.

Suffixes start at content-selected positions only: of every `min_words` consecutive words, the k-gram with the smallest hash
(the minimiser).  Two equal passages of `min_words` words select the same k-gram at the same place, so sorting the selected
suffixes brings them together.  A suffix is sorted by its k-gram and then by its run: the stretch of words, from left of the
k-gram to right of it, over which this k-gram stays the minimum.  In that order

* a suffix whose predecessor has the same k-gram and run repeats an earlier passage over the whole run;
* a suffix whose k-gram has other runs as well is extended word by word to the left and right: its windows of `min_words` words
  are hashed, sorted, and each that equals its predecessor repeats an earlier one;
* all others are unique.

Both sorts are range partitionings on (key, document, place), which split even a passage that a third of all documents share.
Only neighbours are compared; what the rows at the partitions' ends need of their neighbours is a small table of two rows a
partition, which is joined.

Every row is a document of its own: the first table that is written gives it a key, which suffixes, windows, spans and the cut
carry along, so null and repeated ids mix nothing up.  Ids only say which row is the earlier one, and are reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzite.llm.common import arrow_batches, drop, materialize, new_path, width
from quartzite.llm.scan import NON_SPACE, U, mix, spans, text_chunks, window_hashes, word_hashes

MIN_WORDS, GRAM = 50, 20
#: Rows that one partition of a sort may hold.
PART_ROWS = 1 << 20
#: Words that are searched for minimisers at once; longer documents are cut with an overlap.
STEP = 1 << 18
#: Stands for a null id, which counts as the smallest.
NULL_ID = np.iinfo(np.int64).min

SUFFIX = "gram long, run long, id long, doc long, at long, n long"


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive entries."""
    n = len(x) - w + 1
    full = np.concatenate([x, np.full(-len(x) % w + w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    right = np.minimum.accumulate(full, axis=1).ravel()
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[w - 1 : w - 1 + n])


def runs(h: np.ndarray, doc: np.ndarray, min_words: int, k: int) -> tuple[np.ndarray, ...]:
    """(gram, run hash, document, first window, number of windows) of the selected suffixes of some documents' words."""
    out = []
    for a in range(0, max(1, len(h)), STEP):
        x, d = h[a : a + STEP + min_words - 1], doc[a : a + STEP + min_words - 1]
        n = len(x) - min_words + 1
        if n <= 0:
            continue
        g = window_hashes(x, k)
        low = _sliding_min((g >> U(24) << U(24)) | np.arange(len(g), dtype=np.uint64), min_words - k + 1)
        ok = d[:n] == d[min_words - 1 :]
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        place = (low[at] & U((1 << 24) - 1)).astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        # a run is at most min_words - k + 1 windows long, so its first and its last window have all its words
        wide = window_hashes(x, min_words)
        run = mix(mix(wide[first] + (last - first).astype(np.uint64)) ^ mix(wide[last] + (place[new] - first).astype(np.uint64)) * U(0xD6E8FEB86659FD93))
        out.append((g[place[new]], run, d[first], first + a, last - first + 1))
    if not out:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _select(batches: Iterator[pa.RecordBatch], min_words: int, k: int) -> Iterator[pa.RecordBatch]:
    """(id, doc, text) to suffixes."""
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(2)):
            h, doc = word_hashes(raw, offs, NON_SPACE, lower=False)
            per = np.bincount(doc, minlength=j - i)
            first = np.cumsum(per) - per
            gram, run, d, at, n = runs(h, doc, min_words, k)
            if len(gram):
                ids, keys = (batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), run.view(np.int64), ids[d], keys[d], at - first[d], n)], ["gram", "run", "id", "doc", "at", "n"])


def _columns(batches: Iterator[pa.RecordBatch], n: int) -> list[np.ndarray]:
    got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * n


COMPARED = "part int, kind int, gram long, run long, id long, doc long, at long, n long, earlier long"
#: kinds of rows: repeats its predecessor; to be extended; belongs to the partition's first or last k-gram; the partition's first or last row
REPEAT, EXTEND, EDGE, HEAD, TAIL = range(5)


def _table(cols: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, t in zip(cols, (x.split()[1] for x in schema.split(", ")), strict=True)], [x.split()[0] for x in schema.split(", ")])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: keeps what repeats or may.

    HEAD and TAIL rows are the first and the last row; their n and at are the number of rows and the largest run of their k-gram
    in the partition (if both have one k-gram, TAIL has none of it), their earlier is the smallest run.
    """
    part = TaskContext.get().partitionId()
    gram, run, ident, doc, at, n = _columns(batches, 6)
    if not len(gram):
        return
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(gram))
    mixed = run[starts] != run[ends - 1]  # sorted by run within a k-gram
    alike = np.concatenate([[False], ~new[1:] & (run[1:] == run[:-1])])
    earlier = np.concatenate([[NULL_ID], ident[:-1]])
    kind = np.where(alike, REPEAT, np.where(mixed[group], EXTEND, -1))
    edge = ((group == 0) | (group == group[-1])) & ~alike
    kind[edge] = EDGE
    keep = np.flatnonzero(kind >= 0)
    yield _table([np.full(len(keep), part), kind[keep], *(c[keep] for c in (gram, run, ident, doc, at, n, earlier))], COMPARED)
    rows = []
    for tail, g in ((0, 0), (1, len(starts) - 1)):
        i, j = starts[g], ends[g]
        row = j - 1 if tail else 0
        rows.append((part, TAIL if tail else HEAD, gram[row], run[row], ident[row], doc[row], run[j - 1], 0 if tail and g == 0 else j - i, run[i]))
    yield _table([np.array(c) for c in zip(*rows, strict=True)], COMPARED)


def _settle(compared: DataFrame) -> DataFrame:
    """Decide the rows at the partitions' ends: (kind, doc, at, n, earlier) of all that repeat or are to be extended.

    The first row of a partition repeats the last one before it if both have the same k-gram and run; any other row of a k-gram
    at an end is to be extended if the k-gram has other runs in any partition.
    """
    ends = compared.where(F.col("kind") >= HEAD)
    total = ends.groupBy("gram").agg(F.min("earlier").alias("lo"), F.max("at").alias("hi"))
    order = Window.partitionBy("gram", "run").orderBy("part", "kind")
    heads = ends.withColumn("before", F.lag(F.struct("kind", "id")).over(order)).where(F.col("kind") == HEAD)
    heads = heads.select("part", "gram", "run", "id", "doc", F.col("before.kind").alias("k0"), F.col("before.id").alias("id0"))
    heads = heads.select(F.col("part").alias("p"), F.col("gram").alias("g"), F.col("run").alias("r"), (F.col("k0") == TAIL).alias("follows"), "id0")
    edge = compared.where(F.col("kind") == EDGE)
    edge = edge.join(heads, (F.col("part") == F.col("p")) & (F.col("gram") == F.col("g")) & (F.col("run") == F.col("r")), "left").drop("p", "g", "r")
    edge = edge.join(total.select(F.col("gram").alias("g"), "lo", "hi"), F.col("gram") == F.col("g"))
    edge = edge.withColumn("kind", F.when(F.col("follows"), REPEAT).when(F.col("lo") < F.col("hi"), EXTEND)).where("kind is not null")
    edge = edge.select("kind", "doc", "at", "n", F.when(F.col("follows"), F.col("id0")).otherwise(F.col("earlier")).alias("earlier"))
    return compared.where(F.col("kind") < EDGE).select("kind", "doc", "at", "n", "earlier").unionByName(edge)


def _windows(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(id, doc, text, [(at, n)]) to the hashes of the windows: (window, id, doc, at)."""
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(2)):
            h, doc = word_hashes(raw, offs, NON_SPACE, lower=False)
            first = np.cumsum(np.bincount(doc, minlength=j - i)) - np.bincount(doc, minlength=j - i)
            wins = window_hashes(h, min_words)
            part = batch.column(3).slice(i, j - i)
            per, runs_ = np.diff(part.offsets.to_numpy()), part.flatten()
            at, n = (runs_.field(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            row = np.repeat(np.repeat(np.arange(j - i), per), n)
            s = np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)
            ids, keys = (batch.column(c).slice(i, j - i).to_numpy(zero_copy_only=False) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (wins[first[row] + s].view(np.int64), ids[row], keys[row], s)], ["win", "id", "doc", "at"])


WINDOW = "part int, end int, win long, id long, doc long, at long, earlier long"


def _compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition of windows: those that repeat their predecessor (end 0), and the first (1) and the last row (2)."""
    part = TaskContext.get().partitionId()
    win, ident, doc, at = _columns(batches, 4)
    if not len(win):
        return
    same = np.concatenate([[False], win[1:] == win[:-1]])
    earlier = np.concatenate([[NULL_ID], ident[:-1]])
    keep = np.concatenate([np.flatnonzero(same), [0, len(win) - 1]])
    end = np.zeros(len(keep), np.int64)
    end[-2:] = 1, 2
    yield _table([np.full(len(keep), part), end, *(c[keep] for c in (win, ident, doc, at, earlier))], WINDOW)


def _settle_windows(met: DataFrame) -> DataFrame:
    """(doc, at, earlier) of the windows that repeat one before them, in their partition or at the end of the one before."""
    before = F.lag(F.struct("end", "id")).over(Window.partitionBy("win").orderBy("part", "end"))
    heads = met.where("end > 0").withColumn("before", before).where(F.col("end") == 1).where(F.col("before.end") == 2)
    return met.where("end = 0").select("doc", "at", "earlier").unionByName(heads.select("doc", "at", F.col("before.id").alias("earlier")))


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    at = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the overlapping passages of each document: (doc, [(at, end, earlier)]) to (doc, spans, earlier_ids)."""
    for batch in batches:
        doc, parts = batch.column(0), batch.column(1)
        flat = parts.flatten()
        row = np.repeat(np.arange(len(doc)), np.diff(parts.offsets.to_numpy()))
        at, end, earlier = (flat.field(c).to_numpy(zero_copy_only=False) for c in range(3))
        order = np.lexsort((at, row))
        row, at, end = row[order], at[order], end[order]
        base = row * (int(end.max()) + 2 if len(end) else 1)  # rows apart, so that one running maximum serves all
        lo, hi = _merge(at + base, end + base)
        r = np.searchsorted(base, lo, side="right") - 1
        r = row[r]
        base = r * (int(end.max()) + 2 if len(end) else 1)
        n = np.bincount(r, minlength=len(doc))
        spans_ = pa.StructArray.from_arrays([pa.array(lo - base), pa.array(hi - base)], ["start", "end"])
        names = np.unique(np.stack([row, earlier[order]]), axis=1)
        names = names[:, names[1] != NULL_ID]
        offs = lambda c: pa.array(np.append(0, np.cumsum(c)), pa.int32())
        yield pa.RecordBatch.from_arrays([doc, pa.ListArray.from_arrays(offs(n), spans_), pa.ListArray.from_arrays(offs(np.bincount(names[0], minlength=len(doc))), pa.array(names[1]))], ["doc", "spans", "earlier_ids"])


def number_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written copy of `docs` as (id, doc, text, c0, c1, ...): `doc` is the row's own key, c0.. are the other columns in order."""
    others = [c for c in docs.columns if c != text_col]
    cols = [F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))).alias("id"), F.monotonically_increasing_id().alias("doc"), F.col(text_col).cast("string").alias("text")]
    return materialize(docs.select(*cols, *(F.col(c).alias(f"c{i}") for i, c in enumerate(others))), "rows")


def repeats_of(rows: DataFrame, min_words: int = MIN_WORDS, k: int = GRAM) -> DataFrame:
    """(doc, spans, earlier_ids) of the rows of `number_rows` with repeated passages."""
    spark = rows.sparkSession
    arrow_batches(spark)
    src = rows.select("id", "doc", "text")
    suffix_path, path, win_path, met_path = (new_path(spark, x) for x in ("suffixes", "compared", "windows", "met"))
    suffixes = materialize(src.mapInArrow(partial(_select, min_words=min_words, k=k), SUFFIX), "suffixes", suffix_path)
    parts = max(width(spark), -(-suffixes.count() // PART_ROWS))
    keys = ["gram", "run", "id", "doc", "at"]
    compared = materialize(suffixes.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare, COMPARED), "compared", path)
    drop(spark, suffix_path)
    settled = _settle(compared)
    whole = settled.where(F.col("kind") == REPEAT).select("doc", "at", (F.col("at") + F.col("n") + (min_words - 1)).alias("end"), "earlier")
    open_runs = settled.where(F.col("kind") == EXTEND).groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    keys = ["win", "id", "doc", "at"]
    wins = materialize(src.join(open_runs, "doc").select("id", "doc", "text", "runs").mapInArrow(partial(_windows, min_words=min_words), "win long, id long, doc long, at long"), "windows", win_path)
    parts = max(width(spark), -(-wins.count() // PART_ROWS))
    met = materialize(wins.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare_windows, WINDOW), "met", met_path)
    drop(spark, win_path)
    found = whole.unionByName(_settle_windows(met).select("doc", "at", (F.col("at") + min_words).alias("end"), "earlier"))
    found = found.groupBy("doc").agg(F.collect_list(F.struct("at", "end", "earlier")).alias("parts"))
    out = materialize(found.mapInArrow(_join_spans, "doc long, spans array<struct<start:long,end:long>>, earlier_ids array<long>"), "repeats")
    drop(spark, path, met_path)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = GRAM) -> DataFrame:
    """(`id_col`, spans, earlier_ids) for each row with words that repeat an earlier passage of `min_words` words or more.

    A word is a run of non-blank characters, compared by 64-bit hashes of its bytes.  Earlier: in the order of (id, row, place), in
    the same text or another; null ids come first, rows of the same id, repeated rows among them, go in the order of the table's
    partitions.  spans: merged [start, end) in words.  earlier_ids: ids, but null ones, of documents that hold the passages before it in the sort.
    Null, empty and short texts, and an empty table, have none.  A very long text is searched in stretches and never cut short.
    Other columns are ignored.
    """
    rows = number_rows(docs.select(id_col, text_col), id_col, text_col)
    found = repeats_of(rows, min_words, k)
    return rows.select("doc", F.col("c0").alias("_id")).join(found, "doc").select(F.col("_id").alias(id_col), "spans", "earlier_ids")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, spans) at columns 0 and 1, others behind: the text without these words and the blanks after each."""
    for batch in batches:
        texts = []
        for i, j, raw, offs in text_chunks(batch.column(0)):
            found = batch.column(1).slice(i, j - i)
            s, _, doc = spans(raw, offs, NON_SPACE)
            per = np.bincount(doc, minlength=j - i)
            first = np.cumsum(per) - per
            for r in range(j - i):
                text = batch.column(0)[i + r]
                if not found[r].is_valid or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                base, end, own = offs[r], offs[r + 1], s[first[r] : first[r] + per[r]]
                kept, at = [], base
                for part in found[r].as_py():
                    kept.append(raw[at : own[part["start"]]].tobytes())
                    at = own[part["end"]] if part["end"] < len(own) else end
                texts.append((b"".join(kept) + raw[at:end].tobytes()).decode())
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], names=batch.schema.names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = GRAM) -> DataFrame:
    """`docs` with every passage that repeats an earlier one (see `repeated_passages`) cut from the text; all rows, other columns and texts as they are.

    Of repeated rows, the first keeps its text.  Any names and types of other columns, null ids and texts, and an empty table are fine.
    """
    rows = number_rows(docs, id_col, text_col)
    found = repeats_of(rows, min_words, k).select("doc", "spans")
    others = [c for c in docs.columns if c != text_col]
    joined = rows.join(found, "doc", "left").select("text", "spans", *(f"c{i}" for i in range(len(others))))
    cut = joined.mapInArrow(_cut, joined.schema)
    place = {c: f"c{i}" for i, c in enumerate(others)} | {text_col: "text"}
    return cut.select(*(F.col(place[c]).alias(c) for c in docs.columns))


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """A row for each document with repeated passages: how many, their words in all, and their places in words."""
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    places = F.array_join(F.transform("spans", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_repeated"), places.alias("spans"))


ORACLE_SQL = {
    "op6_suffix_array_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, p, array_to_string(w[p:p + {MIN_WORDS - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {MIN_WORDS - 2})) AS p FROM d WHERE len(w) >= {MIN_WORDS})),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM p),
h AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM r WHERE k > 1),
s AS (SELECT doc_id, p, sum(CASE WHEN gap IS NULL OR gap > {MIN_WORDS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM h),
e AS (SELECT doc_id, n, min(p) - 1 AS a, max(p) + {MIN_WORDS - 1} AS b FROM s GROUP BY doc_id, n)
SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_repeated, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM e GROUP BY doc_id""",
}
