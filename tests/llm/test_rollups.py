import shutil
from collections import Counter

from pyspark.sql import functions as F

from quartzite.llm import rollups
from quartzite.llm.rollups import TokenRollup, op5_token_counts, revisions, token_changes
from quartzite.llm.tokens import vocabulary, word_bpe

COLS = "doc_id long, text string, lang string, source string, sign int, tokens string"
ROWS = [(1, "It's one two", "en", "a", 1, "x"), (2, "Straße über", "de", "a", 1, "x"), (2, "Straße über", "de", "a", 1, "x"), (3, None, "en", "b", 1, "x"), (4, "", None, "b", 1, "x"), (None, "中文 text", "zh", None, 1, "x"), (6, "w " * 5000, "en", "a", 1, "x")]


def expect(rows):
    bpe, out = word_bpe(vocabulary()).whole, Counter()
    for _, text, lang, source, *_ in rows:
        for tok, n in (("word_bpe_49k.json", len(bpe.encode(text or "", add_special_tokens=False).ids)), ("blank_words", len((text or "").split()))):
            out[source, lang, tok, "n"] += 1
            out[source, lang, tok, "t"] += n
    return {k: v for k, v in out.items() if v}


def got(rollup):
    return {k: v for r in rollup.totals().collect() for k, v in (((r.source, r.lang, r.tokenizer, "n"), r.documents), ((r.source, r.lang, r.tokenizer, "t"), r.tokens)) if v}


def test_inserts_deletes_revisions_and_repeated_commits(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLS).repartition(2)
    r = TokenRollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    assert r.commit("load/1 ü", token_changes(df))
    assert got(r) == expect(ROWS)
    assert not r.commit("load/1 ü", token_changes(df))
    assert got(r) == expect(ROWS)
    assert r.commit("drop", token_changes(df.where("doc_id = 2"), -1))
    left = [x for x in ROWS if x[0] != 2]
    assert got(r) == expect(left)
    new = [(1, "changed text here", "en", "a", 1, "x"), *left[1:-1], (9, "fresh", "fr", "c", 1, "x")]
    assert r.commit("revise", revisions(spark.createDataFrame(left, COLS), spark.createDataFrame(new, COLS)))
    assert got(TokenRollup(spark, str(tmp_path / "r"))) == expect(new)


def test_a_died_draft_counts_for_nothing(spark, tmp_path):
    r = TokenRollup(spark, str(tmp_path / "r"))
    token_changes(spark.createDataFrame(ROWS, COLS)).groupBy("source").agg(F.count("*")).write.parquet(str(tmp_path / "r" / "draft-dead"))
    assert r.totals().count() == 0
    assert r.commit("x", token_changes(spark.createDataFrame(ROWS, COLS).limit(0)))
    assert r.totals().count() == 0


def test_compaction_keeps_totals_and_ids(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLS)
    r = TokenRollup(spark, str(tmp_path / "r"))
    assert not r.compact()
    r.commit("one", token_changes(df))
    r.commit("two", token_changes(df.where("doc_id = 1"), -1))
    left = [x for x in ROWS if x[0] != 1]
    assert r.compact() and got(r) == expect(left) and not r.compact()
    assert [p.name[:5] for p in (tmp_path / "r").iterdir()] == ["base-"]
    assert not r.commit("one", token_changes(df)) and r.committed("two") and got(r) == expect(left)
    r.commit("three", token_changes(df))
    assert r.compact() and got(TokenRollup(spark, str(tmp_path / "r"))) == expect(left + ROWS)
    assert not r.commit("three", token_changes(df)) and len(list((tmp_path / "r").iterdir())) == 1


def test_a_compaction_that_died_before_it_cleaned_up(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLS)
    r = TokenRollup(spark, str(tmp_path / "r"))
    r.commit("one", token_changes(df))
    kept = tmp_path / "kept"
    batch = next((tmp_path / "r").glob("batch-*"))
    shutil.copytree(batch, kept)
    r.compact()
    shutil.copytree(kept, batch)  # as if its folder had not gone
    assert got(r) == expect(ROWS) and not r.commit("one", token_changes(df))
    assert not r.compact() and not batch.exists() and got(r) == expect(ROWS)


def test_revisions_count_only_what_changed(spark):
    old = spark.createDataFrame(ROWS, COLS)
    same = old.unionByName(old.limit(0))
    assert revisions(old, same).count() == 0
    more = spark.createDataFrame([*ROWS, ROWS[1], ROWS[1]], COLS)
    rows = revisions(old, more).collect()
    assert [(r.sign, r.tokens) for r in rows if r.tokenizer == "blank_words"] == [(2, 2)]
    assert {r.sign for r in revisions(more, old).collect()} == {-2}


def test_query_equals_counting_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rollups, "REVISED", "en")
    docs = [r[:4] for r in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op5_token_counts(spark, str(tmp_path)).collect()
    assert {k: v for r in rows for k, v in (((r.source, r.lang, r.tokenizer, "n"), r.documents), ((r.source, r.lang, r.tokenizer, "t"), r.tokens)) if v} == expect(ROWS)
