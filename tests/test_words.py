"""Word tokens and identifiers that are found in the rows themselves, against the SQL."""

import re
from collections import Counter

import duckdb
import pytest

from quartzite import registry
from quartzite.functions import words as W

NAMES = ("q_detokenize", "q_identifier_topk", "q_word_token_size", "q_word_tokens", "q_dynamic_dictionary")
TEXTS = ["alpha Beta GAMMA alpha_1 beta beta délta alpha", None, "", "  ", "word Word WORD wOrd 9word", "ééé", "return return return value value value x x x", "a\0b alpha"]
ROWS = {
    "unique": [(i, t) for i, t in enumerate(TEXTS)],
    "one null id": [(i or None, t) for i, t in enumerate(TEXTS)],
}


def result(rows, names):
    return sorted(repr(tuple(r[n] for n in names)) for r in rows)


@pytest.mark.parametrize("kind", ROWS)
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_without_moving_rows(spark, tmp_path, name, kind):
    spark.createDataFrame(ROWS[kind], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert result(df.collect(), names) == result(want, names)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan  # no row for each word


@pytest.mark.parametrize("sent", (100_000, 0))
@pytest.mark.parametrize("name", ("q_word_token_size", "q_word_tokens"))
def test_repeated_ids(spark, tmp_path, monkeypatch, name, sent):
    from quartzite.operators import text

    monkeypatch.setattr(text, "SENT_IDS", sent)
    rows = [(i // 2 if i != 4 else None, t) for i, t in enumerate(TEXTS)] + [(None, "alpha word"), (1, "beta")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert result(registry.QUERIES[name](spark, str(tmp_path)).collect(), names) == result(want, names)


def test_repeated_ids_of_identifiers(spark, tmp_path):
    """Counts of all rows of an id together; an id's single row is as before."""
    rows = [(1, "value value other"), (1, "value one more"), (2, "single single single")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    top = {(r.doc_id, r.word): r.n for r in registry.QUERIES["q_identifier_topk"](spark, str(tmp_path)).collect()}
    assert top == {(1, "value"): 3, (1, "other"): 1, (1, "one"): 1, (1, "more"): 1, (2, "single"): 3}
    own = {(r.doc_id, r.slot, r.word, r.n) for r in registry.QUERIES["q_dynamic_dictionary"](spark, str(tmp_path)).collect()}
    assert own == {(1, 0, "value", 3), (2, 0, "single", 3)}


def test_stretches(monkeypatch):
    x = ("alpha Beta é GAMMA x1_y 9z " * 50 + "q" * 300 + " " * 300 + "end").encode()
    code = W.codes([b"alpha", b"beta", b"gamma"])
    want = (W.counts(x, code), W.sizes(x, code), W.split(x, code), W.names(x))
    form = [f(w) for f in (bytes, bytes.upper, bytes.capitalize) for w in [b"alpha", b"beta", b"gamma", *[b""] * (W.MAX_WORDS - 3)]]
    assert W.joined(*want[2], form) == x
    assert want[3][0] == Counter(re.findall(rb"[a-zA-Z_][a-zA-Z0-9_]*", x))
    cut = W._stretches
    monkeypatch.setattr(W, "_stretches", lambda x, end: cut(x, end, 64))
    assert (W.counts(x, code), W.sizes(x, code), W.split(x, code), W.names(x)) == want
    assert list(W.names(x)[0]) == list(want[3][0])


def test_parts_are_replaced_without_a_call_for_each(monkeypatch):
    known = [b"alpha", b"beta", b"the"]
    table, meaning = W.forms(known), W.inverse(known)
    x = "The alpha BETA gamma é 1the_beta wOrd ".encode() * 40 + b"\xff\x80 end \xc3"
    want = re.sub(rb"[a-zA-Z]+|[\x80-\xff]", lambda m: table.get(m[0], m[0]), x)
    for size in (1 << 20, 1, 5, 64):
        monkeypatch.setattr(W, "PIECE", size)
        assert W.encode(x, table) == want
        assert W.decode(want, meaning) == W.decode(want, known) == x
        assert W.decode(b"\xa0\x07 \x9f\xff \x80", known) == b"\xa0\x07 \x9f\xff \x80"  # no words: they stay
