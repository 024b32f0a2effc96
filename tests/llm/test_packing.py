import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quartzite.llm import packing
from quartzite.llm.packing import best_fit, pack, pack_documents
from quartzite.llm.tokens import vocabulary, word_bpe


def fewest(sizes, capacity):
    """Rows that sequential best-fit decreasing uses."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            g = min(fit)
            gaps.remove(g)
            gaps.append(g - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sweep_uses_as_few_rows_as_sequential_best_fit(sizes):
    rows, ranks = defaultdict(list), defaultdict(set)
    placed, left, gaps, n = best_fit([(s, 0, c) for s, c in Counter(sizes).items()], [], 20, 0)
    assert not left and n == len({row + r for _, _, m, row, _ in placed for r in range(m)})
    for size, lo, m, row, offset in placed:
        for r in range(m):
            rows[row + r].append((offset, size))
            ranks[size].add(lo + r)
    assert {s: len(r) for s, r in ranks.items()} == Counter(sizes)
    free = {}
    for k, parts in rows.items():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 20
        free[k] = 20 - at
    assert {k: f for k, f in free.items() if f} == {row + r: g for g, row, m in gaps for r in range(m)}
    assert len(rows) == fewest(sizes, 20)


def test_without_new_rows_nothing_is_lost():
    placed, left, gaps, rows = best_fit([(5, 0, 4), (3, 0, 2)], [(5, 7, 2), (9, 0, 1)], 20, None)
    assert rows is None and sorted(placed) == [(3, 0, 1, 0, 16), (5, 0, 2, 7, 15), (5, 2, 1, 0, 11)] and sorted(left) == [(3, 1, 1), (5, 3, 1)] and gaps == [(1, 0, 1)]


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


def test_pack_keeps_columns_and_ties(spark):
    rng = np.random.default_rng(2)
    sizes = [*rng.integers(1, 65, 500).tolist(), *[64] * 300, *[7] * 400]
    df = spark.createDataFrame([(i, s, "x", None) for i, s in enumerate(sizes)], "c0 long, length int, size string, row string").repartition(5)
    rows = pack(df, "length", 64).collect()
    assert sorted((r.c0, r.length, r.size, r.row) for r in rows) == sorted((i, s, "x", None) for i, s in enumerate(sizes))
    assert check(rows, 64) == fewest(sizes, 64)
    assert pack(df.limit(0), "length", 64).count() == 0
    with pytest.raises(ValueError):
        pack(df, "length", 60)


@pytest.mark.parametrize("kind", ["even", "skewed", "small"])
def test_parallel_sweeps_use_no_more_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "PART_RUNS", 16)
    rng = np.random.default_rng(3)
    sizes = {"even": rng.integers(1, 513, 3000), "skewed": np.minimum(512, rng.lognormal(4, 1.2, 3000).astype(int) + 1), "small": np.concatenate([rng.integers(300, 513, 500), rng.integers(1, 9, 4000)])}[kind].tolist()
    df = spark.createDataFrame([(s, {"x": i}) for i, s in enumerate(sizes)], "length int, odd struct<`x`:int>").repartition(3)
    rows = pack(df, "length", 512).collect()
    assert Counter(r.length for r in rows) == Counter(sizes)
    assert check(rows, 512) <= fewest(sizes, 512)


def test_documents_round_trip(spark):
    texts = ["", None, "one two", "one two", "x y z " * 50, "It's\n%%% été", "long words here " * 30]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = pack_documents(df, capacity=32, keep_ids=True).collect()
    check(rows, 32)
    by = defaultdict(dict)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by[r.doc_id][r.piece] = r
    for i, t in enumerate(texts):
        parts = [by[i if i else None][k] for k in range(len(by[i if i else None]))]
        ids = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in parts])
        assert ids.tolist() == [*word_bpe(vocabulary()).whole.encode(t or "", add_special_tokens=False).ids, 0]
        assert [p.start for p in parts] == [32 * k for k in range(len(parts))] and all(p.length == 32 for p in parts[:-1])
