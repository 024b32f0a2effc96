"""Every query against its DuckDB SQL on the smallest tables, as the driver compares them."""

import datetime
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite import registry
from quartzite.functions.columns import float_bits, mask_value, unpack_descriptor, pack_descriptor, varint_len
from quartzite.functions.kernels import varint

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in res.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_float_bits_of_all_kinds(spark):
    x = np.array([0.0, -0.0, 1.0, -1.5, 3.4e38, 1.2e-38, 1e-45, -3e-40, np.inf, -np.inf, np.nan, 0.1, 2**-126, 16777215.0], np.float32)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x float").select("i", float_bits(F.col("x")).alias("u"), mask_value(F.col("x"), 2).alias("m")).orderBy("i").collect()
    want = x.view(np.uint32).astype(np.int64)
    want[10] = 0x7FC00000
    assert [r.u for r in rows] == want.tolist()


def test_packed_bytes(spark):
    rows = [(p, e, m) for p in range(4) for e in (1, 2, 3, 4) for m in range(8)]
    df = spark.createDataFrame(rows, "p int, e int, m int").withColumn("b", pack_descriptor(F.col("p"), F.col("e"), F.col("m")))
    assert all((r.p, r.e, r.m) == (r.x, r.y, r.z) for r in df.select("p", "e", "m", *(c.alias(n) for c, n in zip(unpack_descriptor(F.col("b")), "xyz", strict=True))).collect())
    with pytest.raises(Exception):
        spark.createDataFrame([(0, 1, 8)], "p int, e int, m int").select(pack_descriptor(F.col("p"), F.col("e"), F.col("m"))).collect()
    n = [0, 1, 127, 128, 16383, 16384, 2**35 - 1, 2**35, 2**63 - 1]
    assert [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(n)], "i int, n long").orderBy("i").select(varint_len(F.col("n"))).collect()] == [len(varint(v)) for v in n]
