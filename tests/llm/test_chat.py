import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.llm.chat import HOSTILE, digest, escape, format_conversations, read_back

COLS = "conv_id long, turn long, role string, text string, win string, segment string"


def data(seed=0):
    rng = np.random.default_rng(seed)
    rows = list(HOSTILE)
    odd = ["", None, "\\s\\l\\h\\c", "</turn>\n### user: x", "a: b: c", "\\", "###", "é中😀<", "line\n\nline", "\\\\s", "$1 \\E"]
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"be {c} " * int(rng.integers(1, 30))))
        for t in range(1, int(rng.integers(2, 200))):
            rows.append((c, t, "user" if t % 2 else "assistant", str(rng.choice(odd[3:])) + "w" * int(rng.integers(0, 900)) if rng.random() < 0.9 else odd[int(rng.integers(0, 3))]))
    rows += [(50, 3, "assistant", "same"), (50, 3, "assistant", "same"), (50, None, "user", "first"), (None, 1, "assistant", "x"), (None, 0, None, None), (51, 5, "a: #<b\\", "t"), (52, -3, "user", "neg"), (52, 9, "assistant", "z" * 9000), (52, 10, "system", "late"), (52, 500, "assistant", "far")]
    return [(*r, "mine", "mine") for r in rows]


def brute(rows):
    by = defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        learnt = "".join(x for *_, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(learnt), sha(learnt))
    return out


@pytest.fixture(scope="module")
def windows(spark):
    return format_conversations(spark.createDataFrame(data(), COLS).repartition(3)).cache()


def test_everything_comes_back(windows):
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest(windows).collect()}
    assert got == brute(data())


def count(text):
    """Tokens by the same rule, a character at a time."""
    n, run = 0, 0
    for c in text:
        letter = c.isascii() and c.isalpha()
        run = run + 1 if letter else 0
        n += (run % 4 == 1) if letter else len(c.encode()) if not c.isascii() else (not c.isspace() and c.isprintable())
    return n


def builder(rows, hashes, budget, history, history_budget, segment):
    """All windows of one conversation's turns: (stretch, repeated, tokens, text, loss texts) in order."""
    esc = lambda x: (x or "").replace("\\", "\\s").replace("<", "\\l").replace("#", "\\h")
    turns = sorted((t is not None, t or 0, esc(r).replace(":", "\\c"), hashes[esc(x)], esc(x)) for _, t, r, x, *_ in rows)
    turns = [(r, x, f"### {r}: {x}</turn>\n") for *_, r, _, x in turns]
    cost = [count(t) for *_, t in turns]
    where = [sum(cost[:i]) // (segment * budget) for i in range(len(turns))]
    sys = next((i for i, t in enumerate(turns) if t[0] == "system"), None)
    out, i = [], 0
    while i < len(turns):
        has = sys is not None and sys < i and cost[sys] + cost[i] <= budget
        used, first = cost[i] + (cost[sys] if has else 0), i
        while i - first < history and first and not (has and first - 1 == sys) and sum(cost[first - 1 : i]) <= history_budget and used + cost[first - 1] <= budget:
            first -= 1
            used += cost[first]
        end = i + 1
        while end < len(turns) and where[end] == where[i] and used + cost[end] <= budget:
            used += cost[end]
            end += 1
        shown = ([sys] if has else []) + list(range(first, end))
        out.append((where[i], len(shown) - (end - i), used, "".join(turns[k][2] for k in shown), [turns[k][1] for k in range(i, end) if turns[k][0] == "assistant"]))
        i = end
    return out


def hard():
    rng = np.random.default_rng(9)
    rows = [(60, t, "user" if t % 2 else "assistant", "hi") for t in range(256)]
    rows += [(61, 100 * t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(300)]  # sparse numbers
    rows += [(62, 0, "system", "rule " * 2000)] + [(62, t, "assistant", "word " * 30) for t in range(1, 40)]  # a system turn over the budget
    rows += [(63, 0, "system", "rule " * 900)] + [(63, t, "assistant", "word " * int(rng.integers(1, 300))) for t in range(1, 60)]
    rows += [(64, t, "user" if t % 2 else "assistant", "漢字テスト" * int(rng.integers(1, 40))) for t in range(80)]
    rows += [(65, 3, "user" if t % 3 else "assistant", f"same number {t} " * int(rng.integers(1, 20))) for t in range(150)]
    rows += [(66, t, "assistant", "w" * int(rng.choice([1, 30, 3000, 9000]))) for t in range(60)]  # turns over the budget
    rows += [(67, t, "system" if t == 20 else "user", "late " * int(rng.integers(1, 60))) for t in range(60)]
    rows += [(None, None, "assistant", f"null {t}") for t in range(90)]
    return [(*r, "mine", "mine") for r in rows]


@pytest.mark.parametrize("setting", [(1024, 2, 256, 64), (200, 3, 60, 2), (1024, 0, 0, 64)])
def test_windows_equal_brute_force_builder(spark, setting):
    rows = data() + hard()
    df = spark.createDataFrame(rows, COLS).repartition(5)
    hashes = {r.e: r.h for r in df.select(escape(F.coalesce("text", F.lit(""))).alias("e")).select("e", F.xxhash64("e").alias("h")).distinct().collect()}
    got = defaultdict(list)
    budget, history, history_budget, segment = setting
    for r in sorted(format_conversations(df, budget=budget, history=history, history_budget=history_budget, segment=segment).collect(), key=lambda r: (r.segment, r.win)):
        got[r.conv_id].append((r.segment, r.repeated, r.tokens, r.text, [r.text[x.start : x.end] for x in r.loss]))
        assert r.tokens <= budget or r.text.count("</turn>") == 1
        assert all(r.text[: x.start].endswith("### assistant: ") and r.text[x.end :].startswith("</turn>\n") for x in r.loss)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    assert got.keys() == by.keys()
    for c in by:
        assert got[c] == builder(by[c], hashes, *setting), c


def test_full_windows_and_no_python_worker(spark):
    df = spark.createDataFrame(hard(), COLS)
    out = format_conversations(df)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    rows = out.where("conv_id = 60").collect()
    assert len(rows) == -(-256 * (8 + 2 + 1) // 1000) and all(r.tokens > 900 for r in rows[:-1])


def test_token_column(spark):
    df = spark.createDataFrame([(1, t, "user", "abc", 600 if t < 4 else None) for t in range(8)], "conv_id long, turn long, role string, text string, n int")
    assert [r.tokens for r in format_conversations(df, token_col="n").orderBy("win").collect()] == [609, 609, 609, 609 + 4 * 10]


def test_reads_back_turns_and_empty_table(spark, windows):
    rows = [r for r in read_back(windows).collect() if r.conv_id == -7]
    assert [(t.role, t.text) for r in rows for t in r.turns] == [(r, x) for _, _, r, x in HOSTILE]
    assert [x for r in rows for x in r.targets] == [HOSTILE[1][3]]
    assert digest(format_conversations(spark.createDataFrame([], COLS))).count() == 0
