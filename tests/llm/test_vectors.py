import numpy as np

from quartzite.llm import vectors
from quartzite.llm.vectors import near_vectors


def brute(rows, cosine=0.98):
    ids = [i for i, _, _ in rows]
    links = {i: set() for i in ids}
    good = []
    for i, label, v in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good.append((i, label, x / np.linalg.norm(x)))
    for a, (i, la, x) in enumerate(good):
        for j, lb, y in good[:a]:
            if la == lb and len(x) == len(y) and x @ y >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def data(seed=0, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (1, 2, None):
        for _ in range(60):
            v = rng.normal(size=dim)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((label, (v * rng.uniform(0.5, 3) + rng.normal(size=dim) * rng.uniform(0, 0.35)).astype(np.float32).tolist()))
        walk = rng.normal(size=dim)
        for _ in range(40):
            walk = walk + rng.normal(size=dim) * 0.12
            rows.append((label, walk.astype(np.float32).tolist()))
    rows += [rows[0]] * 30 + [(1, None), (1, [0.0] * dim), (1, [float("nan")] + [1.0] * (dim - 1)), (2, [None] + [1.0] * (dim - 1)), (2, []), (2, [1.0] * (dim + 1)), (2, [float("inf")] * dim)]
    return [(i * 5 % 10007, label, v) for i, (label, v) in enumerate(rows)]


def test_equals_brute_force_over_cells_and_blocks(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(3)
    expect = brute(rows)
    assert got(near_vectors(df)) == expect
    monkeypatch.setattr(vectors, "PER_CELL", 30)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "SAMPLE", 50)
    assert got(near_vectors(df)) == expect
    monkeypatch.setattr(vectors, "DEAL", 20)
    monkeypatch.setattr(vectors, "FAN", 2)  # several levels
    assert got(near_vectors(df)) == expect


def test_cells_grow_with_every_label_and_models_stay_bounded(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 25)
    monkeypatch.setattr(vectors, "SAMPLE", 60)
    monkeypatch.setattr(vectors, "FAN", 4)
    rng = np.random.default_rng(1)
    homes = []
    for n in (200, 1600):
        rows = [(k * 10000 + i, f"label {k}", rng.normal(size=24)) for k in range(3) for i in range(n)]
        same = spark.createDataFrame([(label, (v / np.linalg.norm(v)).tobytes(), i, 1) for i, label, v in rows], "label string, unit binary, rep long, n long")
        cells, paths = vectors.cells_of(same, 0.98)
        own = cells.where("own")
        assert own.count() == 3 * n and own.select("rep").distinct().count() == 3 * n
        models = [spark.read.parquet(p) for p in paths if "model" in p]
        assert all(m.where("length(model) > 4 * 24 * 8").isEmpty() for m in models) and len(models) > 2
        homes.append(own.select("cell").distinct().count())
        per = [r["count"] for r in own.groupBy("cell").count().collect()]
        assert max(per) < 25 * 12
    assert homes[1] > 4 * homes[0]


def test_a_cell_that_no_split_helps_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PER_CELL", 25)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, 0, (base + rng.normal(size=16) * 0.02).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert got(near_vectors(df)) == brute(rows)


def test_an_id_with_several_vectors(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.01, 1.0])]
    out = near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_repeated_rows_nulls_and_empty_table(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(1, 0, v, "x"), (1, 0, v, "y"), (None, 0, v, "z"), (4, 0, [2.0, 4.0], "u")], "vec_id long, label int, embedding array<double>, unit string")
    assert sorted(map(tuple, near_vectors(df).collect()), key=str) == sorted([(1, 2, 1, True), (1, 2, 1, True), (4, 2, 1, False), (None, 0, None, True)], key=str)
    assert near_vectors(df.limit(0)).collect() == []
