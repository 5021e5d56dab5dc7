"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from evoframe import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.5f}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, DATA)
    theirs = duck.sql(registry.ORACLE[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    a = sorted(tuple(plain(r[c]) for c in columns) for r in ours.collect())
    at = [theirs.columns.index(c) for c in columns]
    b = sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_gram_of_all_components(spark):
    import numpy as np
    import pyarrow.parquet as pq

    x = np.array(pq.read_table(f"{DATA}/embeddings.parquet", columns=["embedding"]).column(0).drop_null().to_pylist(), np.float64)
    got = np.full((x.shape[1],) * 2, np.nan)
    rows = registry.QUERIES["stats_gram_whole"](spark, DATA).collect()
    for r in rows:
        got[r.i, r.j] = r.moment
    assert x.shape[1] > 8 and len(rows) == got.size and np.allclose(got, x.T @ x / len(x), atol=1e-6)
