"""Benchmark decontamination on a positional inverted index.

The index is sharded by document: a row is a segment of a few megabytes of text with its documents, its sorted terms, and the
ascending positions of every term.  Building it moves nothing between executors, a segment's size doesn't depend on how often a
word or passage occurs, and each segment answers a query alone.  A query's windows take their terms from the rarest to the most
frequent in the whole index, each list shifted by the term's offset and intersected with what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.llm.common import arrow_batches, materialize
from quartzite.llm.scan import ALNUM, text_chunks, word_hashes

#: Words of a segment, and words of test items that one pass over the index takes; the broadcast is some 100 bytes a word at most.
SEGMENT_WORDS, BLOCK_WORDS = 1 << 20, 1 << 18
#: Stands for a null item id: its windows hit words, but it is no item that could be named.
NO_ITEM = int(np.iinfo(np.int64).min)
INDEX = "segment string, ids binary, words binary, terms binary, counts binary, positions binary"


def _blob(x: np.ndarray) -> pa.Array:
    """One binary value, without a copy."""
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes], np.int32)), pa.py_buffer(x)])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids, words, terms, size = [], [], [], 0

    def segment() -> pa.RecordBatch:
        h = np.concatenate(terms) if len(terms) > 1 else terms[0]
        order = np.argsort(h, kind="stable").astype(np.uint32)  # positions of a term stay ascending
        s = h[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        values = (np.concatenate(ids), np.concatenate(words), s[at], np.diff(np.append(at, len(s))).astype(np.uint32), order)
        return pa.RecordBatch.from_arrays([pa.array([f"{part}-{made}"]), *map(_blob, values)], ["segment", "ids", "words", "terms", "counts", "positions"])

    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(1)):
            h, doc = word_hashes(raw, offs, ALNUM)
            own = batch.column(0).slice(i, j - i)
            # a null id is kept as the smallest number
            ids.append(own.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            words.append(np.bincount(doc, minlength=j - i).astype(np.int64))
            terms.append(h)
            size += len(h)
            if size >= SEGMENT_WORDS:
                yield segment()
                ids, words, terms, size, made = [], [], [], 0, made + 1
    if ids:
        yield segment()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the index of `docs` to `path` (or the shared folder).  Null and empty texts are documents without words."""
    arrow_batches(docs.sparkSession)
    return materialize(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_index, INDEX), "postings", path)


class Segment:
    def __init__(self, row: dict):
        self.ids, self.words = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["words"], np.int64)
        self.terms, self.counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.positions, self.first = np.frombuffer(row["positions"], np.uint32), np.cumsum(self.counts) - self.counts
        self.ends = np.cumsum(self.words)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Place of each term in the segment's list, -1 where it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def postings(self, i: int) -> np.ndarray:
        return self.positions[self.first[i] : self.first[i] + self.counts[i]].astype(np.int64)

    def doc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, position, side="right")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Segment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row["segment"], Segment(row)


class Windows:
    """The windows of some items: distinct term sequences, the items of each, and the distinct terms."""

    def __init__(self, items: list[tuple[int, np.ndarray]], length: int):
        found: dict[tuple[int, ...], set[int]] = {}
        for item, h in items:
            n = min(len(h), length)
            for i in range(len(h) - n + 1) if n else ():
                found.setdefault(tuple(h[i : i + n].tolist()), set()).add(item)
        self.keys = [np.array(k, np.uint64) for k in found]
        self.items = [sorted(v) for v in found.values()]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]))
        self.at = [np.searchsorted(self.terms, k) for k in self.keys]
        self.matrix = np.full((len(self.at), length), -1)
        for i, x in enumerate(self.at):
            self.matrix[i, : len(x)] = x
        self.counts = np.zeros(len(self.terms), np.int64)

    def present(self, seg: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Place of the terms in `seg`, and the windows that have all theirs there."""
        where = seg.find(self.terms)
        has = np.append(where >= 0, True)  # the last stands for no term
        return where, np.flatnonzero(has[self.matrix].all(axis=1))


def _term_counts(batches: Iterator[pa.RecordBatch], windows: Broadcast) -> Iterator[pa.RecordBatch]:
    w = windows.value
    total = np.zeros(len(w.terms), np.int64)
    for _, seg in _segments(batches):
        where = seg.find(w.terms)
        total[where >= 0] += seg.counts[where[where >= 0]]
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["term", "n"])


def _exact(seg: Segment, where: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Starts of the occurrences of one window within a document."""
    left = None
    for i in np.argsort(counts[at], kind="stable"):
        p = seg.postings(where[at[i]])
        if left is None:
            left = p - i
        else:
            j = np.minimum(np.searchsorted(p, left + i), len(p) - 1)
            left = left[p[j] == left + i]
        if not len(left):
            return left
    left = left[left >= 0]
    return left[seg.doc(left) == seg.doc(left + len(at) - 1)]


def _match(batches: Iterator[pa.RecordBatch], windows: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per document: its ids and words, the hit spans (merged), the items."""
    w = windows.value
    for name, seg in _segments(batches):
        n = len(seg.ids)
        where, left = w.present(seg)
        starts, lens, docs, items = [], [], [], []
        for i in left:
            s = _exact(seg, where, w.at[i], w.counts)
            if len(s):
                starts.append(s)
                lens.append(np.full(len(s), len(w.at[i])))
                d = np.unique(seg.doc(s))
                for item in (x for x in w.items[i] if x != NO_ITEM):
                    docs.append(d)
                    items.append(np.full(len(d), item))
        spans, found = [[]] * n, [[]] * n
        if starts:
            s, e = np.concatenate(starts), np.concatenate(starts) + np.concatenate(lens)
            edge = np.zeros(int(seg.ends[-1]) + 1, np.int32)
            np.add.at(edge, s, 1)
            np.add.at(edge, e, -1)
            hit = np.cumsum(edge) > 0
            # spans of neighbouring documents are told apart
            step = hit[1:] != hit[:-1]
            up, down = np.flatnonzero(step & hit[1:]) + 1, np.flatnonzero(step & hit[:-1]) + 1
            up = np.append(0, up) if hit[0] else up
            cuts = np.unique(np.concatenate([up, seg.ends[(seg.ends < len(hit) - 1)]]))
            cuts = cuts[hit[cuts]]
            ends = np.minimum(down[np.searchsorted(down, cuts, side="right")], seg.ends[seg.doc(cuts)])
            d = seg.doc(cuts)
            first = seg.ends - seg.words
            pairs = np.stack([cuts - first[d], ends - first[d]], axis=1)
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            for i, j in zip(at, np.append(at[1:], len(d)), strict=True):
                spans[d[i]] = [{"start": a, "end": b} for a, b in pairs[i:j].tolist()]
            docs, items = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (docs, items))
            both = np.unique(np.stack([docs, items], axis=1), axis=0)
            at = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]])) if len(both) else np.zeros(0, np.int64)
            for i, j in zip(at, np.append(at[1:], len(both))[: len(at)], strict=True):
                found[both[i, 0]] = both[i:j, 1].tolist()
        ids = pa.array([None if x == np.iinfo(np.int64).min else x for x in seg.ids.tolist()], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(seg.words), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.int64()))], ["segment", "place", "doc_id", "n_words", "spans", "items"])


MATCH = "segment string, place int, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _merged(spans):
    """Overlapping spans of several passes as one each."""
    span = lambda a, b: F.array(F.struct(a.alias("start"), b.alias("end")))
    first = F.slice(spans, 1, 0)
    add = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), span(F.element_at(acc, -1)["start"], F.greatest(F.element_at(acc, -1)["end"], s["end"])))).otherwise(F.concat(acc, span(s["start"], s["end"])))
    return F.aggregate(F.array_sort(spans), first, add)


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(1)):
            h, doc = word_hashes(raw, offs, ALNUM)
            n = np.bincount(doc, minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([h[e - c : e].tobytes() for c, e in zip(n, np.cumsum(n), strict=True)], pa.binary())], ["id", "words"])


def _blocks(items: DataFrame, id_col: str, text_col: str, length: int) -> Iterator[Windows]:
    """The items in blocks of about BLOCK_WORDS words; only one block is held at a time."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_item_words, "id long, words binary")
    block, size = [], 0
    for item, words in rows.toLocalIterator():
        block.append((NO_ITEM if item is None else item, np.frombuffer(words, np.uint64)))
        size += len(words) // 8
        if size >= BLOCK_WORDS:
            yield Windows(block, length)
            block, size = [], 0
    yield Windows(block, length)


def _counted(index: DataFrame, windows: Windows) -> Broadcast:
    sc = index.sparkSession.sparkContext
    plain = sc.broadcast(windows)
    for term, n in index.select("segment", "ids", "words", "terms", "counts", F.lit(b"").alias("positions")).mapInArrow(partial(_term_counts, windows=plain), "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        windows.counts[term] = n
    return sc.broadcast(windows)


def phrase_matches(index: DataFrame, items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per document of the index: doc_id, n_words, spans ([start, end) in words, merged), items with an occurring window.

    A window is `window` consecutive words of an item, or all words of an item that has fewer; items without words match nothing.
    The windows of items without an id hit words, but are in no list of items.  Repeated items count once, repeated documents
    each, a null document id is a document like any other; long texts are searched whole, an empty table gives no row, without
    items nothing is hit; other columns are ignored whatever their names.
    """
    parts = [index.mapInArrow(partial(_match, windows=_counted(index, w)), MATCH) for w in _blocks(items, id_col, text_col, window)]
    if len(parts) == 1:
        return parts[0].select("doc_id", "n_words", "spans", "items")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    out = out.groupBy("segment", "place").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return out.select("doc_id", "n_words", _merged(F.flatten("s")).alias("spans"), "items")


def _near(batches: Iterator[pa.RecordBatch], windows: Broadcast, slop: int) -> Iterator[pa.RecordBatch]:
    w = windows.value
    for _, seg in _segments(batches):
        where, left = w.present(seg)
        first = seg.ends - seg.words
        out = set()
        for i in left:
            reach = len(w.at[i]) + slop
            order = sorted(set(w.at[i].tolist()), key=lambda t: w.counts[t])
            lists = [seg.postings(where[t]) for t in order]
            p = lists[0]
            for q in lists[1:]:
                p = p[np.searchsorted(q, p - reach + 1) < np.searchsorted(q, p + reach)]
            for x in p.tolist():
                d = int(seg.doc(np.array([x]))[0])
                lo, hi = max(int(first[d]), x - reach + 1), min(int(seg.ends[d]), x + reach)
                near = sorted((y, t) for t, q in enumerate(lists) for y in q[np.searchsorted(q, lo) : np.searchsorted(q, hi)].tolist())
                need, has, start = len(lists), {}, 0
                for y, t in near:
                    has[t] = has.get(t, 0) + 1
                    while len(has) == need:
                        t0 = near[start][1]
                        has[t0] -= 1
                        if not has[t0]:  # the shortest span that ends here starts here
                            del has[t0]
                            if y - near[start][0] < reach:
                                out.update((d, near[start][0], y + 1, item) for item in w.items[i] if item != NO_ITEM)
                        start += 1
        rows = sorted(out)
        low = np.iinfo(np.int64).min
        yield pa.RecordBatch.from_arrays([pa.array([None if (x := int(seg.ids[d])) == low else x for d, _, _, _ in rows], pa.int64()), pa.array([item for *_, item in rows], pa.int64()), pa.array([int(s - first[d]) for d, s, _, _ in rows], pa.int64()), pa.array([int(e - first[d]) for d, _, e, _ in rows], pa.int64())], ["doc_id", "item_id", "start", "end"])


def proximity_matches(index: DataFrame, items: DataFrame, window: int = 10, slop: int = 2, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end): the shortest spans that hold all distinct words of a window, in any order, and are at most `slop` words longer than it."""
    out = None
    for w in _blocks(items, id_col, text_col, window):
        part = index.mapInArrow(partial(_near, windows=_counted(index, w), slop=slop), "doc_id long, item_id long, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words inside an occurrence), items."""
    found = phrase_matches(build_index(docs, id_col, text_col), items, window, item_col, item_text)
    return found.select(F.col("doc_id").alias(id_col), "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"), "items")


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_SQL = {
    "op8_benchmark_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT r, p, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)""",
}
