import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quartzite.llm import jaccard
from quartzite.llm.jaccard import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, num=80, den=100):
    sets = {i: shingles(t) for i, t in rows}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, c in Counter(j for x in s for j in by[x] if j < i).items():
            if c * den >= num * (len(s) + len(sets[j]) - c):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(n=120, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    line = " ".join(rng.choice(words, 12))
    texts = []
    for _ in range(n):
        t = rng.choice(words, int(rng.integers(1, 250))).tolist()
        for _ in range(int(rng.integers(0, 4))):
            u = list(t)
            for _ in range(int(rng.integers(0, 1 + len(u) // 30))):
                u[int(rng.integers(len(u)))] = "EDIT"
            texts.append(" ".join(u))
        texts.append(" ".join(t) + ("\n" + line if rng.random() < 0.4 else ""))
    base = rng.choice(words, 150).tolist()
    for _ in range(60):  # one large group of near copies, chained
        base[int(rng.integers(150))] = str(rng.choice(words))
        texts.append(" ".join(base))
    common = " ".join(rng.choice(words, 90))
    texts += [common + " " + " ".join(rng.choice(words, int(rng.integers(1, 25)))) for _ in range(60)]
    texts += [texts[0]] * 20 + ["", "  \n", "a b", "A B", "a b c d e", "x y", None]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("heavy", "sent"), [(64, 1000), (10, 0)])
def test_equals_brute_force(spark, monkeypatch, heavy, sent):
    monkeypatch.setattr(jaccard, "MIN_HEAVY", heavy)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "SENT_GROUPS", sent)
    rows = corpus()
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_columns_nulls_repeats_and_empty_table(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(3, t, "x", 1), (3, t, "y", 2), (None, t + " end", "z", 3), (1, None, None, None)], "doc_id long, text string, cls string, n int")
    rows = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert rows == [(1, 0, 1), (3, 36, 3), (3, 36, 3), (None, 37, None)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_many_just_under_the_threshold(spark, monkeypatch):
    """A shared passage puts all in one group; none is linked but a few, which the closest ones don't show."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choice(words, 100).tolist()
    texts = [" ".join(base + rng.choice(words, 26).tolist()) for _ in range(90)]
    texts += [" ".join(base + rng.choice(words, 23).tolist()) for _ in range(30)]
    texts += [t + " more" for t in texts[::11]]
    rows = list(enumerate(texts))
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_settle_emits_a_forest_of_verified_links():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[: 400 - k], rng.integers(0, 2**63, k).astype(np.uint64)])) for k in range(0, 60)]
    sketch = [np.packbits((np.bincount((s & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).astype(bool)).tobytes() for s in sets]
    n = len(sets)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([0] * n), pa.array([0] * n), pa.array(range(n)), pa.array([len(s) for s in sets]), pa.array(range(n)), pa.array(sketch, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "cell", "blk", "cls", "n", "at", "sketch", "shingles"])
    edges = [(a, b) for out in jaccard._settle(iter([batch.slice(0, 7), batch.slice(7)]), 80, 100) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)]
    like = lambda x, y: (c := len(np.intersect1d(sets[x], sets[y]))) * 100 >= 80 * (len(sets[x]) + len(sets[y]) - c)
    assert all(like(a, b) for a, b in edges)
    root = list(range(n))

    def find(x):
        return x if root[x] == x else find(root[x])

    for x in range(n):
        for y in range(x):
            if like(x, y):
                root[find(x)] = find(y)
    assert len(edges) == n - len({find(x) for x in range(n)})


def test_an_id_with_several_texts_and_unlike_words_of_one_linear_hash(spark):
    rng = np.random.default_rng(6)
    text = lambda: " ".join(f"v{x}" for x in rng.integers(0, 9999, 60))
    a, b = text(), text()
    thue = "a"
    while len(thue) < 2048:
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(5, a), (5, b), (2, a + " tail"), (3, b + " tail"), (8, thue), (9, other)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in out.collect()) == [(2, 2), (3, 3), (5, 2), (5, 3), (8, 8), (9, 9)]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.97])
def test_a_very_large_set_publishes_the_same_parts(monkeypatch, share):
    import pyarrow as pa

    class Heavy:
        pass

    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 3000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    (_, h, _), *_ = jaccard._sets(batch, 5)
    sent = Heavy()
    sent.value = np.sort(rng.choice(h, int(share * len(h)), replace=False))
    bands = jaccard.Bands(80, 100)
    layout = {"ranges": np.minimum(7, bands.m), "subs": np.full(len(bands.m), 2), "base": np.arange(len(bands.m)) * 14}

    def rows():
        out = []
        for b in jaccard._signatures(iter([batch]), 5, bands, sent, layout):
            for bucket, keys, classes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                out += [(bucket, k, classes) for k in np.frombuffer(keys, np.uint64).tolist()]
        return sorted(out)

    whole = rows()
    monkeypatch.setattr(jaccard, "SLICE", 200)
    assert rows() == whole and len(whole) > 300


def test_sketch_and_class_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    text = " ".join(f"w{i * i % 977}" for i in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "a b c d e f"])], ["id", "text"])
    one = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["id", "text"])
    full = [r for b in jaccard._profile(iter([batch]), 5) for r in b.to_pylist() if r["sketch"]]
    monkeypatch.setattr(jaccard, "SLICE", 100)
    assert [r for b in jaccard._profile(iter([one]), 5) for r in b.to_pylist() if r["sketch"]] == full[:1]
