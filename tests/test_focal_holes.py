"""Neighbourhoods of rasters with holes and a broken last row have rows for the cells of the table only, by both paths."""

import duckdb
import pytest

from cubelith import queries
from cubelith.plans import options

NAMES = ["bilateral", "focal_mean", "focal_mean_tiles", "focal_range", "morphology", "shrink_footprint"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("holes"))
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 258 AND vec_id % 37 <> 5) TO '{folder}/embeddings.parquet'")
    return folder


@pytest.mark.parametrize("path", ["cells", "tiles"])
@pytest.mark.parametrize("name", NAMES)
def test_only_cells_of_the_table(spark, table, name, path):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{table}/embeddings.parquet'")
    want = c.sql(queries.SQL[name])
    options.put(spark, focalPath=path, tile=8)
    try:
        df = queries.QUERIES[name](spark, table)
        got = sorted(repr(tuple(r[n] for n in want.columns)) for r in df.collect())
    finally:
        options.put(spark, focalPath="auto", tile=256)
    assert got == sorted(map(repr, want.fetchall()))
    assert len(got) == 251


@pytest.mark.parametrize("path", ["cells", "tiles"])
@pytest.mark.parametrize("name", NAMES)
def test_values_that_are_no_numbers_are_not_missing(spark, tmp_path, name, path):
    value = "CASE vec_id % 3 WHEN 0 THEN 'nan' WHEN 1 THEN 'inf' ELSE '-inf' END::FLOAT"
    duckdb.sql(f"COPY (SELECT vec_id, CASE WHEN vec_id % 97 IN (5, 6, 40) THEN list_concat([{value}], embedding[2:]) ELSE embedding END AS embedding FROM '/root/testdata/sf0.001/embeddings.parquet' WHERE vec_id < 258 AND vec_id % 37 <> 5) TO '{tmp_path}/embeddings.parquet'")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = c.sql(queries.SQL[name])
    options.put(spark, focalPath=path, tile=8)
    try:
        got = sorted(repr(tuple(r[n] for n in want.columns)) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    finally:
        options.put(spark, focalPath="auto", tile=256)
    assert got == sorted(map(repr, want.fetchall()))
