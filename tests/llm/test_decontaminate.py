import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "中", "O'k"]
    text = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, text(int(rng.integers(1, 25)))) for i in range(30)] + [(30, None), (31, ""), (32, "Rare Word"), (5, text(12)), (None, text(12))]
    docs = []
    for i in range(150):
        t = text(int(rng.integers(0, 60)))
        if i % 3 == 0:
            own = str(items[int(rng.integers(0, 30))][1])
            t = f"{t}, {own.upper().replace(' ', ' -- ')}! {t}"
        docs.append((i, t))
    docs += [(150, None), (151, ""), (152, "rare\nWORD rare word"), (152, "rare\nWORD rare word"), (None, items[0][1]), (153, items[3][1].split()[0])]
    return docs, items


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        if w:
            k = min(len(w), n)
            for p in range(len(w) - k + 1):
                wins.setdefault(tuple(w[p : p + k]), set()).update({i} - {None})
    lens = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for k in lens:
            for p in range(len(w) - k + 1):
                got = wins.get(tuple(w[p : p + k]))
                if got is not None:
                    hit[p : p + k] = [True] * k
                    found |= got
        out.append((i, len(w), sum(hit), tuple(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment,block", [(1 << 20, 1 << 18), (300, 60)])
def test_equals_brute_force(spark, monkeypatch, segment, block):
    monkeypatch.setattr(D, "SEGMENT_WORDS", segment)
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, segment string, place int").repartition(3)
    i = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, doc_id string")
    got = D.contamination(d, i).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in got), key=str) == brute(docs, items)


def test_query_digest_of_nothing(spark):
    d, i = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    r = D.contamination(d, i).first()
    assert (r.n_words, r.n_hit, r["items"]) == (2, 0, [])
    assert D.contamination(d.limit(0), i).count() == 0
    assert spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0] == sha256(b"").hexdigest()


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(list("abcdefgh"), 30))) for i in range(25)]
    items = [(1, "a b c"), (2, "d a d"), (3, "zz a")]
    index = D.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {tuple(r) for r in D.proximity_matches(index, spark.createDataFrame(items, "item_id long, text string"), slop=1).collect()}
    want = set()
    for d, t in docs:
        w = t.split()
        for item, q in items:
            need, reach = set(q.split()), len(q.split()) + 1
            for s in range(len(w)):
                for e in range(s + 1, min(len(w), s + reach) + 1):
                    inner = w[s:e]
                    if need <= set(inner) and not need <= set(inner[1:]) and not need <= set(inner[:-1]):
                        want.add((d, item, s, e))
    assert got == want and want
