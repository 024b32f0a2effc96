import re
from collections import Counter

import numpy as np

from quartzite.llm import suffixes
from quartzite.llm.suffixes import remove_repeats, repeated_passages, runs

WORDS = [f"w{i}" for i in range(4000)]


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    p, q = text(60), text(130)
    half = " ".join(q.split()[40:100])
    docs = [text(200), f"{text(30)} {p}\n{text(30)}", f"{text(80)} {p} {text(9)}", f"{p}", f"{text(5)} {q} {text(50)}", f"{text(7)}\t{half}  {text(20)}", f"{q} {p}", f"{half} {q}", "", None, "a b c", "x " * 300, text(49), text(50)]
    docs += [docs[0]] * 3 + [f"{text(3)} {half} {text(3)}" for _ in range(20)]
    return [(i * 3 % 101, t) for i, t in enumerate(docs)]


def brute(rows, min_words=50):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^ \t-\r]+", t or "")
        hit = np.zeros(len(w), bool)
        for p in range(len(w) - min_words + 1):
            key = tuple(w[p : p + min_words])
            if key in seen:
                hit[p : p + min_words] = True
            seen.setdefault(key, (i, p))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(int), [0]])))
        if hit.any():
            out[i] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return out


def got(df):
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in df.collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(repeated_passages(df)) == brute(rows)


def test_equals_brute_force_few_words(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["a", "b"], 40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(repeated_passages(df, min_words=8, k=3)) == brute(rows, 8)


def test_cut_text_and_other_columns(spark):
    p = " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"one {p} two", "x", 1), (2, f"tête {p}\nfin ", "y", 2), (3, None, None, 3), (None, "", "z", 4), (5, "a  b", "c0", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c0 string, spans int")
    out = remove_repeats(df)
    assert out.columns == df.columns
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[3]) == [(1, f"one {p} two", "x", 1), (2, "tête fin ", "y", 2), (3, None, None, 3), (None, "", "z", 4), (5, "a  b", "c0", 5)]


def test_repeated_rows_and_empty_table(spark):
    p = " ".join(f"p{i}" for i in range(80))
    df = spark.createDataFrame([(4, p), (4, p), (9, p)], "doc_id long, text string")
    assert [(r.doc_id, [tuple(x) for x in r.spans], r.earlier_ids) for r in repeated_passages(df).sort("doc_id").collect()] == [(4, [(0, 80)], [4]), (9, [(0, 80)], [4])]
    assert sorted((r.doc_id, r.text) for r in remove_repeats(df).collect()) == [(4, ""), (4, p), (9, "")]
    assert got(repeated_passages(df.limit(0))) == {} and remove_repeats(df.limit(0)).count() == 0


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    p, u = text(70), text(80)
    rows = [(None, "short text"), (None, u), (None, f"{text(5)} {p}"), (1, text(80)), (1, "a b c"), (1, f"{p} {text(9)}"), (1, u), (1, u), (1, None), (None, None), (7, f"{u} {p} {text(60)}"), (7, p), (None, ""), (1, text(3))]
    for parts in (1, 3):
        df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(parts)
        out = remove_repeats(df).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.n) for r in out) == sorted((i is not None, i or 0, n) for n, (i, _) in enumerate(rows))
        words = lambda ts: {tuple(w[k : k + 50]) for t in ts for w in [(t or "").split()] for k in range(len(w) - 49)}
        texts = [r.text for r in sorted(out, key=lambda r: r.n)]
        kept = Counter(tuple(t.split()) for t in texts if t)
        # every passage stays where it stood first in (id, row), and nowhere else
        assert sum(c[: len(u.split())] == tuple(u.split()) for c in kept.elements()) == 1
        assert words(texts) <= words(t for _, t in rows) and {w for t in texts for w in (t or "").split()} == {w for _, t in rows for w in (t or "").split()}
        assert texts[0] == "short text" and texts[1] == u and texts[3] == rows[3][1] and texts[4] == "a b c" and texts[8] is None and texts[12] == "" and texts[13] == rows[13][1]
        assert texts[2] == rows[2][1] and len(texts[5].split()) == 9 and texts[6] == texts[7] == "" and texts[11] == "" and len(texts[10].split()) == 60
        assert len(repeated_passages(df).where("doc_id is null").collect()) == 0


def test_ends_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_ROWS", 40)  # a passage that fills many partitions
    rng = np.random.default_rng(2)
    p = " ".join(rng.choice(WORDS, 120))
    rows = [(i, f"{' '.join(rng.choice(WORDS, int(rng.integers(0, 40))))} {p if i % 3 else ' '.join(p.split()[20:90])} {i}") for i in range(60)]
    assert got(repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)


def test_selection_is_content_defined():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 500).astype(np.uint64)
    shifted = np.concatenate([rng.integers(0, 2**63, 77).astype(np.uint64), h])
    a = runs(h, np.zeros(500, int), 50, 20)
    b = runs(shifted, np.zeros(577, int), 50, 20)
    assert set(a[1][1:-1].tolist()) <= set(b[1].tolist())
