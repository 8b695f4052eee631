"""Options that choose paths, and both paths of neighbourhoods against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelith.cube import Cube
from cubelith.functions import nodata as nd
from cubelith.grid import GridSpec
from cubelith.operators import focal as fo
from cubelith.plans import options, show


@pytest.fixture
def cube(spark):
    a = np.random.default_rng(4).normal(size=(14, 11))
    a[3, 4] = a[9, 9] = np.nan
    rows = [(y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(14) for x in range(11)]
    grid = GridSpec("EPSG:3857", (0.0, 1.0, 0.0, 14.0, 0.0, -1.0), (("x", 11), ("y", 14)), "f64")
    return Cube(spark.createDataFrame(rows, "y int, x int, v double"), grid, ("v",), ("y", "x"))


def test_paths_agree(spark, cube):
    made = {}
    for path in ("cells", "tiles"):
        options.put(spark, focalPath=path, tile=8)
        try:
            made[path] = [f.collect() for f in (fo.shrink_footprint(cube, 2), fo.erode(cube, "v", 2), fo.dilate(cube, "v", 1), fo.bilateral_focal(cube, 0.7, radius=2), fo.focal_kernel(cube, np.full((3, 3), 1 / 9)))]
        finally:
            options.put(spark, focalPath="auto", tile=256)
    for a, b in zip(made["cells"], made["tiles"], strict=True):
        assert np.allclose(a, b, equal_nan=True) and not np.isnan(a).all()


def test_preview_size(spark, cube):
    options.put(spark, previewSize=7)
    try:
        assert show.preview(cube)["v"]["values"].shape == (7, 6)
    finally:
        options.put(spark, previewSize=256)


def test_erf_is_exact(spark):
    x = [*np.linspace(-6, 6, 241).tolist(), 1e-300, -0.0, 30.0, -1e9]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(nd.erf(F.col("x"))).collect()]
    assert max(abs(g - math.erf(v)) for g, v in zip(got, x, strict=True)) < 4e-16
