"""The registered queries on the smallest tables, against their SQL where they have one."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

from quartzite.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in queries.ORACLE_SQL:
        assert got
        return
    duck = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    res = duck.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(row[names.index(c)]) for c in cols)) for row in res.fetchall())
