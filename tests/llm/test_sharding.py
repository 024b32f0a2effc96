from collections import Counter
from hashlib import md5

import pytest

from quartzite.llm.sharding import SHARDS, SLOTS, assign_shards, lookup_table, write_shards


def brute(shards, slots):
    """The turns with each shard's whole preference list."""
    number = lambda t: int(md5(t.encode()).hexdigest()[:15], 16)
    table = {}
    prefs = {s: iter([(number(f"start {s}") % slots + j * (number(f"step {s}") % (slots - 1) + 1)) % slots for j in range(slots)]) for s in sorted(shards)}
    while True:
        for s in sorted(shards):
            slot = next(x for x in prefs[s] if x not in table)
            table[slot] = s
            if len(table) == slots:
                return [table[i] for i in range(slots)]


def test_table_equals_brute_force_and_is_even():
    for shards, slots in ((SHARDS, 1009), (("b", "a", "c"), 7), (("only",), 13)):
        t = lookup_table(shards, slots)
        assert [shards[i] for i in t] == brute(shards, slots)
        n = Counter(t).values()
        assert max(n) - min(n) <= 1
    assert [SHARDS[::-1][i] for i in lookup_table(SHARDS[::-1], 1009)] == brute(SHARDS, 1009)


def test_few_keys_move_when_a_shard_goes():
    a, b = (lookup_table(s) for s in (SHARDS, SHARDS[:-1]))
    moved = sum(x != y for x, y in zip(a, b, strict=True) if SHARDS[x] != SHARDS[-1])
    assert moved / SLOTS < 0.03


def test_wrong_sizes():
    for shards, slots in ((("a", "a"), 7), (("a",), 8), ((), 7), (("a", "b", "c"), 2)):
        with pytest.raises(ValueError):
            lookup_table(shards, slots)


def test_rows_keep_columns_and_go_together(spark, tmp_path):
    df = spark.createDataFrame([(i % 50, "x", "mine", i) for i in range(200)] + [(None, None, None, 1)], "doc_id long, text string, shard string, slots int")
    rows = assign_shards(df, "doc_id").collect()
    assert len(rows) == 201 and rows[0].slots == 0
    assert all(len({(r.slot, r.shard) for r in rows if r.doc_id == k}) == 1 for k in [*range(50), None])
    assert all(r.shard == SHARDS[lookup_table(SHARDS)[r.slot]] for r in rows)
    write_shards(df, "doc_id", str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.doc_id or -1, r.shard) for r in back.collect()) == sorted((r.doc_id or -1, r.shard) for r in rows)
    assert assign_shards(df.limit(0), "doc_id").count() == 0
    odd = spark.createDataFrame([(1, 2, 3, 4, "n")], "_slot int, slot int, of int, row int, name string")
    got = assign_shards(odd, "slot").collect()
    assert [tuple(r)[:4] for r in got] == [(1, 3, 4, "n")] and got[0].shard == SHARDS[lookup_table(SHARDS)[got[0].slot]]
