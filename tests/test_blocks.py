"""Repeated blocks found and restored, against the SQL; how much of the texts is moved for it."""

import random
from collections import Counter
from functools import partial

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quartzite import registry
from quartzite.functions import kernels as K
from quartzite.operators import transforms as T

NAMES = ("q_block_restore", "q_block_dedup")
A, B, C = "a" * 64, "b" * 64, "é" * 32
TEXTS = [A + B + C + "end", None, "", A + A + A, "end", B + "end" + A, A + B + C + "end", C + C + "end", "x", A * 300 + "b", "end", "0\0" * 70]
ROWS = {
    "unique": [*enumerate(TEXTS)],
    "one null id": [(i or None, t) for i, t in enumerate(TEXTS)],
    "null and repeated ids": [((None, 3, 2, 3)[i % 4], t) for i, t in enumerate(TEXTS)],
    "empty": [],
}


def plain(rows, names):
    return sorted(repr(tuple(r[n] for n in names)) for r in rows)


@pytest.mark.parametrize("kind", ROWS)
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, tmp_path, name, kind):
    spark.createDataFrame(ROWS[kind], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    res = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in res.description]
    want = [dict(zip(names, r, strict=True)) for r in res.fetchall()]
    assert plain(registry.QUERIES[name](spark, str(tmp_path)).collect(), names) == plain(want, names)


def shuffled(spark) -> int:
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize(("name", "most"), [("q_block_restore", 3), ("q_block_dedup", 2)])
def test_texts_are_moved_few_times(spark, tmp_path, name, most):
    """Some three quarters of the blocks stand once, as in texts; nothing is broadcast, as nothing is for large tables."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    r = random.Random(7)
    own = [r.randbytes(32 * 50).hex() for _ in range(600)]
    texts = own + [own[i][:1600] + r.randbytes(800).hex() for i in range(300)]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        registry.QUERIES[name](spark, str(tmp_path)).collect()
        moved = (shuffled(spark) - before) / sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert moved < most


@pytest.mark.parametrize("stretch", [1, 3, 1 << 16])
@pytest.mark.parametrize("rows", [1, 2, 1000])
@pytest.mark.parametrize("share", [1, 2, 1 << 10])
def test_runs_over_batches_and_stretches(monkeypatch, stretch, rows, share):
    monkeypatch.setattr(T, "STRETCH", stretch)
    monkeypatch.setattr(T, "SHARE", share)
    values = [(t or "").encode() for t in TEXTS]
    schema = to_arrow_schema(StructType.fromDDL("id long, block_no int, more array<int>, block binary"))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array([t and t.encode() for t in TEXTS], pa.binary())], ["id", "x"])
    found = [r for b in T._distinct(iter([batch]), 64, schema) for r in b.to_pylist()]
    found.sort(key=lambda r: (r["block"], r["id"], r["block_no"]))
    batches = [pa.RecordBatch.from_pylist(found[k : k + rows], schema) for k in range(0, len(found), rows)]
    out = to_arrow_schema(StructType.fromDDL("id long, block_no int, first_id long, first_block_no int, share int, block binary"))
    run = lambda copies: [tuple(r.values()) for b in partial(T._firsts, copies=copies, schema=out)(iter(batches)) for r in b.to_pylist()]
    first, want = {}, {}
    for i, x in enumerate(values):
        for k in range(0, len(x), 64):
            want[i, k // 64] = first.setdefault(x[k : k + 64], (i, k // 64))
    got = run(False)
    assert len(got) == len(want) and {r[:2]: r[2:4] for r in got} == want
    copies = run(True)
    assert sorted(r[:4] for r in copies) == sorted((*p, *f) for p, f in want.items() if p != f)
    shared = [r for r in copies if r[5] is not None]
    assert sorted(r[2:5] for r in shared) == sorted({r[2:5] for r in copies})
    assert max(Counter(r[2:5] for r in copies).values()) <= share
    assert all(r[5] == values[r[2]][r[3] * 64 : r[3] * 64 + 64] for r in shared)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 200])
def test_cut_blocks_come_back(n):
    x = np.arange(n, dtype=np.uint8)
    for bits in range(1 << -(-n // 64)):
        at = np.array([k for k in range(-(-n // 64)) if bits >> k & 1], np.int32)
        cut = [x[k * 64 : k * 64 + 64] for k in at]
        kept = K.cut_blocks(x, at, 64)
        assert len(kept) == n - sum(map(len, cut))
        assert (K.fill_blocks(kept, at, np.concatenate([x[:0], *cut]), 64) == x).all()
