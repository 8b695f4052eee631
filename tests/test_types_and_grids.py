import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cubelith import crs, dtypes
from cubelith.errors import CubeError, GridError
from cubelith.grid import GridSpec, Window, chunks, cross_grid_window, grid_diff, grid_equal, grid_from_bbox, grid_spec, snap_to_blocks, with_halo

TYPES = ["f32", "f64", "i8", "i16", "i32", "i64", "u8", "u16", "u32", "u64", "pred"]


@pytest.mark.parametrize(("a", "b", "want"), [("f32", "i64", "f32"), ("f64", "f32", "f64"), ("i8", "i32", "i32"), ("u8", "i8", "i16"), ("u32", "i8", "i64"), ("i64", "u64", "f64"), ("pred", "u16", "u16"), ("u8", "u16", "u16")])
def test_promotion(a, b, want):
    assert dtypes.promote(a, b) == want == dtypes.promote(b, a)


def test_division_and_reductions():
    assert dtypes.promote("i8", "u16", division=True) == "f32"
    assert dtypes.promote("i64", "u16", division=True) == "f64"
    assert dtypes.of_reduction("count", "f64") == "i32"
    assert dtypes.of_reduction("mean", "i16") == "f32"
    assert dtypes.with_scalar("i16", 2) == "i16"
    assert dtypes.with_scalar("i16", 0.5) == "f32"
    with pytest.raises(CubeError):
        dtypes.promote("x", "f32")


@given(st.sampled_from(TYPES), st.sampled_from(TYPES))
def test_promotion_is_symmetric_and_valid(a, b):
    assert dtypes.promote(a, b) == dtypes.promote(b, a)
    assert dtypes.valid(dtypes.promote(a, b))
    assert dtypes.promote(a, a) == a


def test_grids_are_checked():
    g = grid_spec(3857, (0, 0, 600, 400), res=10)
    assert (g.nx, g.ny) == (60, 40)
    assert g.extent == (0, 0, 600, 400)
    with pytest.raises(GridError):
        GridSpec("EPSG:3857", (0, 10, 1, 0, 0, -10), (("x", 2), ("y", 2)))
    with pytest.raises(GridError):
        GridSpec("EPSG:3857", (0, 10, 0, 0, 0, 10), (("x", 2), ("y", 2)))
    with pytest.raises(GridError):
        grid_spec(3857, (0, 0, 1, 1))
    other = grid_spec(3857, (10, 0, 610, 400), res=10)
    assert grid_diff(g, other) == "transform[0]: 0 and 10"
    assert grid_equal(g, g)
    assert g.stacked("t", ["a", "b"]).without("t", "x", "y").shape == {"x": 1, "y": 1}


@given(st.integers(1, 700), st.integers(1, 700), st.integers(1, 300))
def test_chunks_tile_the_grid(nx, ny, size):
    g = grid_spec(3857, (0, 0, nx, ny), dims=(nx, ny))
    got = list(chunks(g, size))
    assert sum(w.nx * w.ny for w in got) == nx * ny
    for w in got[:5]:
        grown, cut = with_halo(w, g, 3)
        assert grown.ny + cut[0] + cut[2] == w.ny + 6
        assert grown.nx + cut[1] + cut[3] == w.nx + 6


def test_snap():
    assert snap_to_blocks(1000, 256) == 768
    assert snap_to_blocks(100, 256) == 256


@given(st.integers(0, 30), st.integers(0, 20), st.integers(1, 20), st.integers(1, 20))
def test_cross_grid_window_contains_the_truth(y0, x0, ny, nx):
    target = grid_spec(3857, (30, 40, 530, 540), dims=(50, 50))
    source = grid_spec(3857, (0, 0, 700, 700), dims=(100, 100))
    w = cross_grid_window(target, Window(y0, x0, ny, nx), source)
    left, top = 30 + x0 * 10, 540 - y0 * 10
    assert w.x0 <= left / 7 and w.x0 + w.nx >= (left + nx * 10) / 7 - 1e-9
    assert w.y0 <= (700 - top) / 7 and w.y0 + w.ny >= (700 - (top - ny * 10)) / 7 - 1e-9


@pytest.mark.parametrize("system", ["EPSG:3857", "EPSG:32632", "EPSG:32733", "+proj=laea +lat_0=47 +lon_0=9", "+proj=aeqd +lat_0=47 +lon_0=9", "+proj=eqdc +lat_0=47 +lon_0=9 +lat_1=44 +lat_2=50", "+proj=pconic +lat_0=47 +lon_0=9 +lat_1=44 +lat_2=50"])
def test_projections_round_trip(system):
    lon, lat = np.meshgrid(np.linspace(7, 11, 9), np.linspace(45, 49, 9))
    if system == "EPSG:32733":
        lon, lat = lon + 6, -lat
    x, y = crs.from_lonlat(system, lon.ravel(), lat.ravel())
    u, v = crs.to_lonlat(system, x, y)
    assert np.allclose(u, lon.ravel(), atol=1e-7)
    assert np.allclose(v, lat.ravel(), atol=1e-7)


def test_known_places():
    x, y = crs.from_lonlat("EPSG:32631", np.array([3.0]), np.array([0.0]))
    assert abs(x[0] - 500000) < 1e-3 and abs(y[0]) < 1e-3
    x, y = crs.from_lonlat("EPSG:3857", np.array([180.0]), np.array([0.0]))
    assert math.isclose(x[0], 20037508.342789244, rel_tol=1e-12)
    with pytest.raises(GridError):
        crs.from_lonlat("EPSG:2154", np.array([1.0]), np.array([1.0]))
    assert grid_from_bbox((8, 46, 9, 47), 1000, "utm").crs == "EPSG:32632"
