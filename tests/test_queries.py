"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from cubelith import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


def _rows(rows, at):
    return sorted(repr(tuple(_plain(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in queries.SQL:
        want = duck.sql(queries.SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        names = sorted(df.columns)
        assert _rows(got, names) == _rows(want.fetchall(), [want.columns.index(n) for n in names])
