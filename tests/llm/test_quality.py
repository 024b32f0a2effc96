import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.llm.quality import fit, grade_documents, ratings, train

DATA = "/root/testdata/sf0.1"


def test_fit_orders_thresholds_and_recovers_a_direction():
    rng = np.random.default_rng(0)
    x = rng.random((600, 8))
    s = x @ [4, -3, 2, 0, 0, 1, -2, 0]
    grade = np.digitize(s + rng.logistic(size=600) * 0.1, np.quantile(s, [0.3, 0.7]))
    doc, place = np.divmod(np.arange(600 * 8), 8)
    m = fit(doc, place, x.ravel(), grade, 3)
    assert (np.diff(m.thresholds) > 0).all()
    score = x @ m.weights[:8]
    assert np.mean(np.digitize(score, m.thresholds) == grade) > 0.85
    assert (np.diff(m.tails(score), axis=1) <= 0).all()


def test_fit_without_rows_or_grades():
    m = fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int), 3)
    assert np.isfinite(m.thresholds).all()
    m = fit(np.array([0, 1]), np.array([3, 4]), np.ones(2), np.array([2, 1]), 4)  # no row of grades 0 and 3
    assert (np.diff(m.thresholds) > 0).all()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rated = ratings(labels)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4))
    model = train(docs, rated.where(fold > 0), 3)
    out = grade_documents(docs.join(rated.where(fold == 0), "doc_id"), model).toPandas()
    keep = out.p_top >= 0.5
    assert (keep == (out.grade == 2)).mean() > 0.97
    assert keep[out.grade == 2].mean() > 0.985
    assert keep[out.grade == 1].mean() < 0.1


def test_columns_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "good words here", "a", 1), (1, "good words here", "b", 2), (2, None, None, 3), (None, "%%% !!!", "c", 4), (3, "", "d", None)], "doc_id long, text string, score string, c0 int")
    model = train(df, spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, grade int"), 2)
    out = grade_documents(df.withColumn("nested", F.struct(F.lit(1).alias("a-b"))), model)
    assert out.columns == ["doc_id", "text", "c0", "nested", "score", "expected_grade", "p_top"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.p_top <= 1 for r in rows)
    assert {r.score for r in rows if not r.text} == {0.0}
    assert grade_documents(df.limit(0), model).count() == 0
    assert np.isfinite(train(df.limit(0), spark.createDataFrame([], "doc_id long, grade int"), 3).thresholds).all()


def loss(params, doc, place, value, grade, l2=1e-5):
    """Negative log-likelihood, a row at a time, of weights and thresholds."""
    w, t = params[:-2], [-np.inf, params[-2], params[-1], np.inf]
    out = 0.0
    for i, g in enumerate(grade):
        s = sum(w[p] * v for d, p, v in zip(doc, place, value, strict=True) if d == i)
        cdf = [1 / (1 + np.exp(-(x - s))) if np.isfinite(x) else float(x > 0) for x in t]
        out -= np.log(max(cdf[g + 1] - cdf[g], 1e-12))
    return out / len(grade) + 0.5 * l2 * float(w @ w)


def test_fit_equals_brute_force_descent_by_numeric_gradients():
    rng = np.random.default_rng(8)
    x = rng.random((40, 3))
    grade = np.digitize(x @ [2.0, -1.5, 0.5] + rng.logistic(size=40) * 0.8, [0.0, 0.7])
    doc, place = np.divmod(np.arange(120), 3)
    data = (doc, place, x.ravel(), grade)
    p = np.array([0.0, 0, 0, -0.5, 0.5])
    gradient = lambda p: np.array([(loss(p + e, *data) - loss(p - e, *data)) / 2e-4 for e in np.eye(5) * 1e-4])
    step = 2.0
    for _ in range(250):
        g = gradient(p)
        while step > 1e-6 and loss(p - step * g, *data) > loss(p, *data):
            step /= 2
        p, step = p - step * g, step * 1.5
    m = fit(*data, 3, rounds=600)
    got = np.concatenate([m.weights[:3].astype(float), m.thresholds])
    assert abs(loss(got, *data) - loss(p, *data)) < 2e-4
    assert np.abs(gradient(got)).max() < 5e-3


def test_bounds_of_the_sample(spark):
    rows = [(i, f"word{i % 7} other text {i}") for i in range(60)] + [(5, "again another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0)], "doc_id long, grade int")  # most without a document
    full, some, few = (train(docs, labels, 2, **kw).weights for kw in ({}, {"max_train": 30}, {"max_features": 100}))
    used = lambda w: int((w != 0).sum())
    assert used(full) > used(some) > used(few) > 0


def test_a_very_long_text_is_counted_in_stretches():
    from quartzite.llm import scan
    from quartzite.llm.quality import features

    words = ["Word", "other", "other", "%%", "x1", "loooooong", "é"]
    rng = np.random.default_rng(0)
    raw = np.frombuffer(" ".join(words[i] for i in rng.integers(0, 7, 700_000)).encode(), np.uint8)
    assert len(raw) > 2 * scan.CHUNK
    _, place, value = features(raw, np.array([0, len(raw)]))
    _, place2, value2 = features(raw, np.array([0, len(raw), len(raw)]))
    assert (place == place2).all() and np.allclose(value, value2)
