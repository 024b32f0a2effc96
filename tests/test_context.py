"""Context models over whole documents, against loops."""

import math
from collections import Counter

import pytest

from quartzite import registry

TEXTS = {
    1: "the cat sat on the mat, the cat sat on the hat. " * 60 + "end",
    2: "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3000)),
    3: "",
    4: None,
    5: "aé" * 40,
    6: "b",
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("context"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def rows(spark, folder, name):
    return {r.doc_id: tuple(r)[1:] for r in registry.QUERIES[name](spark, folder).collect()}


def orders(x: bytes, limit: int = 16) -> list[int]:
    seen, out = set(), []
    for i in range(len(x)):
        k = 0
        while k < min(i, limit) and x[i - k - 1 : i] in seen:
            k += 1
        out.append(k)
        seen.update(x[i - k : i] for k in range(1, min(i, limit) + 1))
    return out


def brute_halving(x: bytes) -> tuple[int, int]:
    f = [1] * 256
    for b in x:
        f[b] += 16
        if sum(f) > 32_000:
            f = [max(1, v // 2) for v in f]
    return sum(f), max(f)


def brute_repeat(x: bytes, order: int) -> int:
    last, bits = {}, 0
    for i, b in enumerate(x):
        c = x[i - order : i] if i >= order else None
        bits += 1 if c is not None and last.get(c) == b else 9
        if c is not None:
            last[c] = b
    return bits


def brute_binary(x: bytes) -> tuple[int, int]:
    zero, one = 1, 1
    for b in x:
        if b % 2:
            one += 4
        else:
            zero += 4
        if zero + one > 4000:
            zero, one = max(1, zero // 2), max(1, one // 2)
    return zero, one


def brute_unigram(x: bytes) -> list[float]:
    seen, out = Counter(), []
    for i, b in enumerate(x):
        out.append((1 + seen[b]) / (256 + i))
        seen[b] += 1
    return out


WANT = {
    "q_ppm_matched_order": lambda x: (len(x), sum(orders(x)), max(orders(x), default=0)),
    "q_unigram_prob": lambda x: (len(x), pytest.approx(-sum(map(math.log2, brute_unigram(x))), abs=1e-3)),
    "q_repeat_cost": lambda x: tuple(brute_repeat(x, k) for k in (1, 2, 4)),
    "q_binary_counts": brute_binary,
    "q_adaptive_freq": brute_halving,
    "q_context_ring": lambda x: (len(x), sum(sum(x[max(0, i - 16) : i]) * (i + 1) for i in range(len(x)))),
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_whole_documents(spark, folder, name):
    assert rows(spark, folder, name) == {k: WANT[name]((t or "").encode()) for k, t in TEXTS.items()}


def test_halving_is_reached():
    assert 256 + 16 * len(TEXTS[1]) > 32_000


def brute_counts(x: bytes) -> list[tuple]:
    out = []
    for k in range(1, 17):
        c, cs, a, sa, e, se = Counter(), Counter(), 0, 0, 0, 0
        for i in range(k, len(x)):
            key = x[i - k : i]
            a, sa, e, se = a + (c[key] > 0), sa + c[key], e + (cs[key, x[i]] > 0), se + cs[key, x[i]]
            c[key] += 1
            cs[key, x[i]] += 1
        out.append((k, max(0, len(x) - k), a, sa, e, se))
    return out


def brute_blend(x: bytes) -> float:
    c, cs, bits = Counter(), Counter(), 0.0
    u, longest = brute_unigram(x), orders(x)
    for i, b in enumerate(x):
        p = u[i]
        if k := longest[i]:
            conf = min(0.9999, 0.5 + 0.5 * k / 16)
            key = x[i - k : i]
            p = max(1e-7, conf * cs[key, b] / c[key] + (1 - conf) * p)
        bits -= math.log2(p)
        for k in range(1, min(i, 16) + 1):
            c[x[i - k : i]] += 1
            cs[x[i - k : i], b] += 1
    return bits


def test_counts_of_all_orders(spark, folder):
    got = sorted(tuple(r) for r in registry.QUERIES["q_ppm_counts_k"](spark, folder).collect())
    assert got == sorted((k, *r) for k, t in TEXTS.items() for r in brute_counts((t or "").encode()))
    assert any(r[1] == 16 and r[3] for r in got)


def test_blend_by_longest_context(spark, folder):
    want = {k: brute_blend((t or "").encode()) for k, t in TEXTS.items()}
    got = rows(spark, folder, "q_ppm_blend")
    assert all(abs(got[k][0] - v) < 1e-3 for k, v in want.items()) and set(got) == set(want)
