"""Quality grades by ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector shared by all grades and ordered thresholds t_0 < t_1 < ...  A text's
features are its words, the first bytes of longer words, its runs of signs, and words that stand twice in a row, hashed into
2**18 places; the value of a place is the square root of its share of all features, so every text has length 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quartzite.llm.common import arrow_batches
from quartzite.llm.scan import ALNUM, CHUNK, LOWER, NON_SPACE, SIGNS, U, mix, pieces, span_hashes, spans, text_chunks

BITS, PREFIXES = 18, (4, 6)
#: Labelled rows that training uses at most, chosen by hash of the id.
MAX_TRAIN = 4_000
#: Features of these rows that are sent to the driver at most, eight bytes each.
MAX_FEATURES = 4_000_000


def _hashed(low: np.ndarray, offs: np.ndarray, last: int | None = None) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(place, document) of each feature, and the last word; `last`: the word before the first."""
    s, e, doc = spans(low, offs, ALNUM)
    p, q, sign = spans(low, offs, SIGNS)
    h = [span_hashes(low, s, e), mix(span_hashes(low, p, q) + U(1))]
    twice = np.flatnonzero((h[0][1:] == h[0][:-1]) & (doc[1:] == doc[:-1]))
    d = [doc, sign, doc[1:][twice]]
    if last is not None and len(doc) and int(h[0][0]) == last:
        d[2] = np.append(d[2], doc[0])
    h.append(np.full(len(d[2]), mix(np.zeros(1, np.uint64) + U(2))[0]))
    for n in PREFIXES:
        long = e - s > n
        h.append(mix(span_hashes(low, s[long], s[long] + n) + U(n)))
        d.append(doc[long])
    return (np.concatenate(h) >> U(64 - BITS)).astype(np.int64), np.concatenate(d), int(h[0][-1]) if len(doc) else last


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, value), ascending by document; at most 2**32 features a call.  A very long text is counted in stretches."""
    if len(offs) == 2 and len(raw) > 2 * CHUNK:
        total, last = np.zeros(1 << BITS, np.int64), None
        for a, b in pieces(raw, NON_SPACE, CHUNK):
            place, _, last = _hashed(LOWER[raw[a:b]], np.array([0, b - a]), last)
            total += np.bincount(place, minlength=1 << BITS)
        place = np.flatnonzero(total)
        d, n = np.zeros(len(place), np.int64), total[place]
    else:
        place, d, _ = _hashed(LOWER[raw], offs)
        x, n = np.unique(d << BITS | place, return_counts=True)
        d, place = x >> BITS, x & ((1 << BITS) - 1)
    total = np.bincount(d, weights=n, minlength=len(offs) - 1)
    return d, place, np.sqrt(n / total[d])


@dataclass
class Ordinal:
    """Weights (float32) and thresholds (ascending) of grades 0..len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k: columns fall from left to right."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        d, place, value = features(raw, offs)
        return np.bincount(d, weights=self.weights[place] * value, minlength=len(offs) - 1)


def fit(doc: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 200, l2: float = 1e-5, rate: float = 0.5) -> Ordinal:
    """Maximum likelihood by Adam on all rows at once; deterministic.  `doc` ascends, `grade` has one entry a document."""
    n = max(1, len(grade))
    k = grades - 1
    share = np.array([(np.sum(grade <= j) + 0.5) / (len(grade) + 1) for j in range(k)])
    first = np.log(share / (1 - share))
    gap = np.log(np.maximum(np.diff(first), 1e-2))
    params = np.concatenate([np.zeros(1 << BITS), first[:1], gap])
    m, v = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    # both sums over the features are runs of a sorted array: by document, and once more by place
    heads = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else doc
    by_place = np.argsort(place, kind="stable")
    its_doc, its_value, its_place = doc[by_place], value[by_place], place[by_place]
    ends = np.flatnonzero(np.concatenate([[True], its_place[1:] != its_place[:-1]])) if len(doc) else doc
    for step in range(1, rounds + 1 if len(grade) else 1):
        w, t = params[: 1 << BITS], params[1 << BITS] + np.concatenate([[0], np.cumsum(np.exp(params[(1 << BITS) + 1 :]))])
        s = np.zeros(len(grade))
        if len(doc):
            s[doc[heads]] = np.add.reduceat(w[place] * value, heads)
        edges = np.concatenate([[-np.inf], t, [np.inf]])
        up, low = sigmoid(edges[grade + 1] - s), sigmoid(edges[grade] - s)
        up[grade == k], low[grade == 0] = 1, 0
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        # derivative of -log p: by the score, and by the thresholds above and below the grade
        g = np.zeros_like(params)
        if len(doc):
            g[its_place[ends]] = np.add.reduceat((du - dl)[its_doc] * its_value, ends) / n
        g[: 1 << BITS] += l2 * w
        dt = (np.bincount(grade, weights=-du, minlength=grades)[:k] + np.bincount(grade, weights=dl, minlength=grades)[1:]) / n
        g[1 << BITS] = dt.sum()
        tail = np.cumsum(dt[::-1])[::-1][1:]
        g[(1 << BITS) + 1 :] = tail * np.exp(params[(1 << BITS) + 1 :])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params -= rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Ordinal(params[: 1 << BITS].astype(np.float32), params[1 << BITS] + np.concatenate([[0], np.cumsum(np.exp(params[(1 << BITS) + 1 :]))]))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, grade, text) to (id, grade, places, values)."""
    for batch in batches:
        for i, j, raw, offs in text_chunks(batch.column(2)):
            d, place, value = features(raw, offs)
            ends = np.searchsorted(d, np.arange(j - i), side="right")
            starts = np.append(0, ends[:-1])
            place, value = place.astype(np.uint32), value.astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), *(pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()) for x in (place, value))], ["id", "grade", "places", "values"])


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES) -> Ordinal:
    """Fit on rated documents: of those with a text, the `max_train` with the smallest hash of the id, as far as their features go into `max_features`.

    Null ids, null grades, grades outside 0..`grades` - 1 and null texts are left out.  Of several grades of one id the best counts, of
    several texts of one id the one whose features come first in byte order.  Without any row the model is flat.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rated = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade")).where(F.col("id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("id").agg(F.max("grade").alias("grade"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null and id is not null")
    rated = rated.join(src.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = src.join(F.broadcast(rated), "id").select("id", "grade", "text").mapInArrow(_featured, "id long, grade int, places binary, values binary")
    rows = rows.groupBy("id", "grade").agg(F.min(F.struct("places", "values")).alias("x"))
    rows = rows.withColumn("upto", F.sum(F.length("x.places") / 4).over(Window.orderBy(F.xxhash64("id"), "id")))  # max_train rows at most
    doc, place, value, grade = [], [], [], []
    for r in sorted(rows.where(F.col("upto") <= max_features).select("id", "grade", "x.places", "x.values").collect(), key=lambda r: r.id):
        place.append(np.frombuffer(r.places, np.uint32).astype(np.int32))
        value.append(np.frombuffer(r["values"], np.float32))
        doc.append(np.full(len(place[-1]), len(grade), np.int32))
        grade.append(r.grade)
    flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return fit(flat(doc, np.int32), flat(place, np.int32), flat(value, np.float32), np.array(grade, np.int64), grades)


def _scored(batches: Iterator[pa.RecordBatch], model: Broadcast, place: int) -> Iterator[pa.RecordBatch]:
    """Append the score."""
    for batch in batches:
        out = [model.value.scores(raw, offs) for _, _, raw, offs in text_chunks(batch.column(place))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], [*batch.schema.names, "_score"])


def grade_documents(docs: DataFrame, model: Ordinal, text_col: str = "text", least: int | None = None, keep_columns: bool = True, id_col: str = "doc_id") -> DataFrame:
    """`docs` with score, expected_grade and p_top = P(grade >= `least`), by default of the highest grade.

    Null, empty and blank texts have score 0; long ones are read whole; repeated rows and null ids are graded each; an empty table
    stays empty.  Other columns pass through, of any type; input columns of the names score, expected_grade and p_top are replaced.
    keep_columns false: only the id and the grades.
    """
    arrow_batches(docs.sparkSession)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keep = [c for c in names if c not in ("score", "expected_grade", "p_top")] if keep_columns else [id_col]
    src = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(names[c]) for c in keep if c != text_col))
    schema = StructType([*src.schema.fields, StructField("_score", DoubleType())])
    out = src.mapInArrow(partial(_scored, model=docs.sparkSession.sparkContext.broadcast(model), place=0), schema)
    tails = [1 / (1 + F.exp(F.lit(float(t)) - F.col("_score"))) for t in model.thresholds]
    least = len(tails) if least is None else least
    return out.select(*((F.col("_text") if c == text_col else F.col(names[c])).alias(c) for c in keep), F.col("_score").alias("score"), sum(tails[1:], tails[0]).alias("expected_grade"), tails[least - 1].alias("p_top"))


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 neither."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


#: A document is kept if it is of the highest grade with this probability at least.
KEEP_AT = 0.5


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")), 3)
    out = grade_documents(docs, model, keep_columns=False)
    return out.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_top", 6).alias("p_keep"), (F.col("p_top") >= KEEP_AT).alias("kept"))
