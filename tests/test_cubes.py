"""Operators on small cubes, against numpy or known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubelith.cube import Cube
from cubelith.errors import FocalPlacement, GridError, PlanError, ReduceUnsupported, WriteError
from cubelith.functions import cells as g
from cubelith.functions import nodata as nd
from cubelith.functions import tensors
from cubelith.grid import GridSpec
from cubelith.operators import focal, gradient, multiband, scan, select, warp
from cubelith.operators.mask import mask
from cubelith.operators.reduce import group_by_time, reduce_over
from cubelith.plans import options, show
from cubelith.sources import safetensors, sinks, stac, tiff
from cubelith.sources.cells import lazy_dataset

INF = math.inf


def make(spark, planes, bands=("v",), dtype="f64"):
    """A cube of {t: array[y, x] or [y, x, band]}; NaN is missing."""
    rows = []
    first = np.atleast_3d(next(iter(planes.values())))
    for t, a in planes.items():
        a = np.atleast_3d(np.asarray(a, float))
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                rows.append((t, y, x, *[None if math.isnan(v) else float(v) for v in a[y, x]]))
    df = spark.createDataFrame(rows, "t string, y int, x int, " + ", ".join(f"{b} double" for b in bands))
    ny, nx = first.shape[:2]
    return Cube(df, GridSpec("EPSG:3857", (0, 10, 0, 10 * ny, 0, -10), (("x", nx), ("y", ny)), dtype), bands)


def plane(spark, a, bands=("v",), dtype="f64"):
    c = make(spark, {"": a}, bands, dtype)
    return Cube(c.df.drop("t"), c.grid, bands, ("y", "x"))


def test_ieee_cells(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 1.0), (-8.0, 0.5), (0.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(nd.divide(a, b), nd.power(a, b), nd.MATH["log"](a), nd.compare(">", a, 0.5), nd.compare("!=", a, 1.0), nd.modulo(F.lit(7), F.lit(-3)), nd.MATH["gamma"](F.lit(5.0)), nd.MATH["erf"](F.lit(0.5)), nd.MATH["digamma"](F.lit(1.0)), nd.MATH["trigamma"](F.lit(1.0))).collect()
    assert [r[0] for r in got] == [INF, -INF, None, None, -16.0, 0.0]
    assert got[4][1] is None
    assert [r[2] for r in got] == [0.0, None, -INF, None, None, -INF]
    assert [r[3] for r in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r[4] for r in got] == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0]
    assert got[0][5] == -2
    assert abs(got[0][6] - 24) < 1e-9 and abs(got[0][7] - math.erf(0.5)) < 2e-7
    assert abs(got[0][8] + 0.5772156649) < 1e-8 and abs(got[0][9] - math.pi**2 / 6) < 1e-8


def test_quantize_rounds_half_to_even_and_bits(spark):
    df = spark.createDataFrame([(2.5, 3), (3.5, 12), (1e9, None), (None, 1)], "v double, q int")
    got = df.select(g.quantize(F.col("v"), "i16", nodata=-1), g.qa_bits(1, 3)(F.col("q"))).collect()
    assert [r[0] for r in got] == [2, 4, 32767, -1]
    assert [r[1] for r in got] == [True, True, False, False]
    with pytest.raises(WriteError):
        g.quantize(F.col("v"), "u8", nodata=-1)


def test_reductions_of_missing_slices(spark):
    c = make(spark, {"a": [[np.nan, 1]], "b": [[np.nan, 3]]})
    for op, want in {"sum": (0, 4), "mean": (np.nan, 2), "min": (INF, 1), "max": (-INF, 3), "count": (0, 2), "median": (np.nan, 2)}.items():
        assert np.array_equal(reduce_over(c, op).collect(), [want], equal_nan=True)
    with pytest.raises(ReduceUnsupported):
        reduce_over(c, "nope")
    with pytest.raises(ReduceUnsupported):
        reduce_over(c, "median", ("x", "y"), strict=True)
    with pytest.raises(ReduceUnsupported):
        reduce_over(c, "sum", ("x",))


def test_monthly_medians(spark):
    days = {"2023-01-05": 10, "2023-01-20": 20, "2023-02-01": 100, "2023-02-20": 200, "2023-03-01": 5, "2023-03-09": 15}
    got = group_by_time(make(spark, {t: np.full((2, 2), v) for t, v in days.items()}), "month").reduce_over("median").collect()
    assert {t: a[0, 0] for t, a in got.items()} == {"2023-01": 15, "2023-02": 150, "2023-03": 10}


def test_grids_must_agree(spark):
    a, b = plane(spark, np.ones((3, 4))), plane(spark, np.ones((4, 3)))
    with pytest.raises(GridError):
        a + b
    assert (a + 1 == a * 2).collect().min() == 1
    with pytest.raises(PlanError):
        a.math("cumsum")
    with pytest.raises(PlanError):
        a["w"]


def test_fill_gaps_and_hampel(spark):
    x = [1.0, np.nan, np.nan, 7.0, np.nan]
    c = make(spark, {f"2023-01-0{i + 1}": [[v]] for i, v in enumerate(x)})
    read = lambda cube: [a[0, 0] for _, a in sorted(cube.collect().items())]
    assert read(scan.fill_gaps(c, "linear")) == [1, 3, 5, 7, 7]
    assert read(scan.fill_gaps(c, "ffill")) == [1, 1, 1, 7, 7]
    assert read(scan.fill_gaps(c, "bfill")) == [1, 7, 7, 7, 7] or np.isnan(read(scan.fill_gaps(c, "bfill"))[-1])
    spike = make(spark, {f"2023-01-0{i + 1}": [[v]] for i, v in enumerate([1, 1.02, 40, 0.98, np.nan, 1.01])})
    got = read(scan.hampel_smooth(spike))
    assert got[2] == pytest.approx(1.01) and np.isnan(got[4])


def test_scan_forward_and_back(spark):
    c = make(spark, {"a": [[1.0]], "b": [[2.0]], "c": [[3.0]]})
    total = lambda carry, x: (carry + x, carry + x)
    read = lambda cube: [a[0, 0] for _, a in sorted(cube.collect().items())]
    assert read(scan.scan_over(c, total, F.lit(0.0))) == [1, 3, 6]
    assert read(scan.scan_over(c, total, F.lit(0.0), reverse=True)) == [6, 5, 3]


def _one_series(y, lvl, slp, obs, kappa):
    """Textbook smoother of one series, by conditioning a joint normal."""
    n = len(y)
    move, state = np.array([[1.0, 1.0], [0.0, 1.0]]), [np.eye(2)]
    for _ in range(n - 1):
        state.append(move @ state[-1])
    cov = np.zeros((n, n))
    noise = np.diag([lvl**2, slp**2])
    for i in range(n):
        for j in range(n):
            s = state[i] @ (kappa * np.eye(2)) @ state[j].T
            for k in range(1, min(i, j) + 1):
                s += state[i - k] @ noise @ state[j - k].T
            cov[i, j] = s[0, 0]
    seen = ~np.isnan(y)
    gain = cov[:, seen] @ np.linalg.inv(cov[np.ix_(seen, seen)] + obs**2 * np.eye(seen.sum()))
    return gain @ y[seen], np.sqrt(np.diag(cov - gain @ cov[seen]))


def test_kalman_smoother_matches_conditioning():
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=15)) + 5
    y[[3, 7, 8]] = np.nan
    level, sd = scan.local_linear_trend(y[None], 1.0, 0.1, 2.0, kappa=1e3)
    want, spread = _one_series(y, 1.0, 0.1, 2.0, 1e3)
    assert np.allclose(level[0], want, atol=1e-5) and np.allclose(sd[0], spread, atol=1e-5)
    few = np.full((1, 15), np.nan)
    few[0, :2] = 1
    assert np.isnan(scan.local_linear_trend(few, 1, 0.1, 2)[0]).all()


def test_focal_paths_agree(spark):
    rng = np.random.default_rng(1)
    a = rng.random((20, 23))
    a[4, 5] = np.nan
    c, w = plane(spark, a), rng.random((3, 3))
    x, y = (focal.focal_kernel(c, w, engine=e).collect() for e in ("cells", "tiles"))
    want = sum(k * s for k, s in zip(w.ravel(), tensors.shifts(a, 1), strict=True))
    assert np.allclose(x, want, equal_nan=True) and np.allclose(y, want, equal_nan=True)
    small = focal.tiles(c, lambda p: sum(tensors.shifts(p, 2)), 2, size=7).collect()
    assert np.allclose(small, sum(tensors.shifts(a, 2)), equal_nan=True)
    with pytest.raises(FocalPlacement):
        focal.focal(reduce_over(make(spark, {"a": a}), "mean", ("x", "y")), sum)


def test_mask_grows_by_disks(spark):
    q = np.zeros((7, 7))
    q[3, 3] = 1
    c = Cube(plane(spark, np.dstack([np.ones((7, 7)), q]), ("v", "q")).df, plane(spark, q).grid, ("v", "q"), ("y", "x"), "q")
    assert np.isnan(mask(c, where=[1.0]).collect()).sum() == 1
    assert np.isnan(mask(c, where=[1.0], dilate_=1).collect()).sum() == 5


def test_geomedian_and_medoid():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 9, 2))
    x[0, 2, 1] = np.nan
    x[2] = np.nan
    m = multiband.weiszfeld(x, 200)
    cost = lambda p: np.sqrt(np.square(x[1] - p).sum(axis=1)).sum()
    assert all(cost(m[1]) <= cost(m[1] + d) + 1e-6 for d in rng.normal(size=(20, 2)) * 0.05)
    assert np.isnan(m[2]).all()
    assert any(np.allclose(multiband.nearest_observed(x, m)[1], v) for v in x[1])


def test_gradient_recovers_finite_differences(spark):
    rng = np.random.default_rng(3)
    a, w = rng.random((8, 8, 2)), rng.random((3, 3))
    c = plane(spark, a, ("v", "u"))
    loss, grad = gradient.value_and_grad(c, w, gradient.squared_error, "v", "u")

    def at(k):
        out = sum(u * s for u, s in zip(k.ravel(), tensors.shifts(a[:, :, 0], 1), strict=True))
        return np.nanmean((out - a[:, :, 1]) ** 2)

    assert loss == pytest.approx(at(w))
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-5
        assert grad.ravel()[i] == pytest.approx((at(w + step.reshape(3, 3)) - at(w - step.reshape(3, 3))) / 2e-5, abs=1e-6)


def test_align_and_points(spark):
    a = np.add.outer(np.arange(10.0) * 100, np.arange(12.0))
    c = plane(spark, a)
    assert warp.align(c, c.grid) is c
    half = GridSpec("EPSG:3857", (0, 20, 0, 100, 0, -20), (("x", 6), ("y", 5)), "f64")
    assert np.allclose(warp.align(c, half, "average").collect(), a.reshape(5, 2, 6, 2).mean(axis=(1, 3)))
    assert np.allclose(warp.align(c, half, "bilinear").collect(), a.reshape(5, 2, 6, 2).mean(axis=(1, 3)))
    p = spark.createDataFrame([(1, 5.0, 95.0), (2, 115.0, 5.0), (3, 500.0, 5.0), (4, 10.0, 90.0)], "id int, x double, y double")
    near = {r.id: r.v for r in warp.extract_points(c, p).collect()}
    assert near[1] == 0 and near[2] == 911 and near[3] is None
    lin = {r.id: r.v for r in warp.extract_points(c, p, interp="bilinear").collect()}
    assert lin[4] == pytest.approx(a[:2, :2].mean())


def test_selection_and_stacks(spark):
    c = make(spark, {"2023-01-01": [[1.0]], "2023-01-15": [[2.0]], "2023-02-01": [[3.0]]})
    assert sorted(select.time_sel(c, "2023-01").collect()) == ["2023-01-01", "2023-01-15"]
    assert sorted(select.time_sel(c, [2]).collect()) == ["2023-02-01"]
    with pytest.raises(PlanError):
        select.time_sel(c, [True])
    s = select.lazy_stack({"a": plane(spark, [[1.0]]), "b": plane(spark, [[5.0]])}, "band")
    assert s.bands == ("a", "b") and s.collect().tolist() == [[[1.0, 5.0]]]


def test_sinks_round_trip(spark, tmp_path):
    a = np.arange(12.0).reshape(3, 4)
    a[1, 1] = np.nan
    c = plane(spark, a)
    path = sinks.write_tif(c, str(tmp_path / "a.tif"), "i16", scale=0.5, nodata=-9)
    planes, grid, nodata = tiff.decode(open(path, "rb").read())
    assert nodata == -9 and planes[0, 2, 3] == 22 and planes[0, 1, 1] == -9 and grid.extent == c.grid.extent
    cells = tiff.read_cells(spark, [path])
    assert cells.where("b1 is null").count() == 1
    with pytest.raises(WriteError):
        sinks.write_tif(c, str(tmp_path / "b.tif"), "u8")
    kept = sinks.materialise(c, str(tmp_path / "m"))
    assert np.array_equal(kept.collect(), a, equal_nan=True)
    with pytest.raises(Exception, match="already exists"):
        sinks.materialise(c, str(tmp_path / "m"))
    assert sinks.group_path("x.tif", "2023/01") == "x-2023-01.tif"
    safetensors.write(tmp_path / "w", {"k": a.astype("float32")})
    assert safetensors.ls(tmp_path / "w") == {"k": (3, 4)}
    assert np.array_equal(safetensors.read(tmp_path / "w")["k"], a.astype("float32"), equal_nan=True)
    tiff.write_raw_cube(tmp_path / "r", a[None])
    assert tiff.read_raw_window(tmp_path / "r", 0, 1, 2, 2, 2).tolist() == [[6, 7], [10, 11]]


def test_stac_items_to_dataset(spark):
    at = ["2023-01-05T10:00:00Z", "2023-01-15T10:00:00.5Z", "2023-02-05T10:00:00+01:00"]
    items = [{"id": f"item-{i}", "bbox": [0, 0, 1, 1], "properties": {"datetime": t, "eo:cloud_cover": c}, "assets": {"B1": {"href": f"https://x/{i}.tif"}}} for i, (t, c) in enumerate(zip(at, [5, 60, 12], strict=True))]
    s = stac.stac_sources(stac.items_from_json(spark, items))
    assert s.first().location == "/vsicurl/https://x/0.tif"
    assert stac.filter_cloud(s, 50).count() == 2
    days = stac.time_slices(s, "day")
    assert [r.slice for r in days.orderBy("datetime").collect()] == ["2023-01-05", "2023-01-15", "2023-02-05"]
    solar = spark.createDataFrame([("2023-06-15T00:16:42.336Z", 179.0, 179.0), ("2023-06-15T23:58:00Z", 179.0, 179.0)], "datetime string, xmin double, xmax double")
    assert [r.slice for r in stac.time_slices(solar, "solar_day", lon=144.3).collect()] == ["2023-06-15", "2023-06-16"]
    cells = spark.createDataFrame([("/vsicurl/https://x/0.tif", 0, 0, 7.0), ("/vsicurl/https://x/1.tif", 0, 0, -1.0)], "location string, y int, x int, v double")
    c = lazy_dataset(cells, days, plane(spark, [[0.0, 0.0]]).grid, ["B1"], nodata={"B1": -1})
    got = c.collect()
    assert got["2023-01-05"][0, 0] == 7 and np.isnan(got["2023-01-15"]).all() and len(got) == 3


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    c = make(spark, {f"2023-01-{i + 1:02d}": rng.random((6, 6)) for i in range(5)})
    a, b = (reduce_over(Cube(c.df.repartition(n), c.grid, c.bands), "median").collect() for n in (1, 17))
    assert np.array_equal(a, b)


def test_drawings_options_and_convolution(spark):
    c = reduce_over(make(spark, {"a": np.arange(9.0).reshape(3, 3)}), "mean")
    assert "mean over t" in show.draw(c) and show.plan_dot(c).startswith("digraph")
    assert "HashAggregate" in show.plan_text(c)
    assert show.preview(c, size=2)["v"]["values"].shape == (2, 2)
    options.put(spark, tile=128)
    assert options.get(spark, "tile") == 128
    with pytest.raises(Exception, match="not allowed"):
        options.put(spark, tile=0)
    x = np.arange(16.0).reshape(1, 4, 4)
    assert np.allclose(tensors.conv2d(x, np.ones((1, 1, 2, 2)), stride=2), [[[10, 18], [42, 50]]])
    assert tensors.upsample2x(x).shape == (1, 8, 8) and tensors.pad_right_bottom(x, 3).shape == (1, 6, 6)
