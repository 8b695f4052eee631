"""Queries on the embeddings' raster take all rows of tables of more than 500."""

import duckdb
import pytest

from cubelith import queries

SF = "/root/testdata/sf0.1"
NAMES = ["band_sel", "arithmetic", "focal_mean", "focal_mean_tiles", "morphology", "align_average", "align_near", "align_bilinear", "align_lanczos", "align_mode", "reduce_band", "quantized_sink", "extract_points"]


@pytest.mark.parametrize("name", NAMES)
def test_all_embeddings(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "customer"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr(tuple(r[i] for i in [want.columns.index(n) for n in names])) for r in want.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == rows
    assert len(rows) >= 480  # 120 of the coarse cells before
