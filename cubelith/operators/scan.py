"""Operators along t that keep its length: running, filling, smoothing."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes
from ..cube import Cube, every_slice, slices_of
from ..errors import PlanError
from ..functions.tensors import nullable

PIXELS = 4096  # in a batch


def _pixel(order: str = "t"):
    return W.partitionBy("y", "x").orderBy(order)


def running(cube: Cube, op: str = "sum", bands: tuple[str, ...] | None = None) -> Cube:
    """Cumulative sum, mean, min, max or count along t; missing cells stay missing and are passed over."""
    fs = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    if op not in fs:
        raise PlanError(f"unknown running {op!r}")
    w = _pixel().rowsBetween(W.unboundedPreceding, W.currentRow)
    return cube.with_values(f"running {op}", lambda c: F.when(c.isNotNull(), fs[op](c).over(w)), bands)


def scan_over(cube: Cube, body: Callable, init: Column, over: str = "t", bands: tuple[str, ...] | None = None, reverse: bool = False, dtype: str | None = None) -> Cube:
    """``body(carry, x) -> (carry, out)``, Columns, along t; ``body(carry, x, label)`` also gets the slice's label.

    ``reverse`` starts at the last slice; outs stay at their slices.
    """
    import inspect

    if over != "t":
        raise PlanError("scans run along t")
    own = tuple(cube.value_bands if bands is None else bands)
    takes_label = len(inspect.signature(body).parameters) == 3
    cells = F.array_sort(F.collect_list(F.struct("t", *cube.bands)))
    series = cube.df.groupBy("y", "x").agg(cells.alias("s"))
    kind = dtypes.spark_type(dtype or dtypes.floating(cube.grid.dtype))
    step = (lambda c, e, b: body(c, e[b].cast("double"), e["t"])) if takes_label else (lambda c, e, b: body(c, e[b].cast("double")))
    source = F.reverse("s") if reverse else F.col("s")
    outs = []
    for b in own:
        empty = F.expr("cast(array() as array<double>)")
        def go(a, e):
            carry, out = step(a["carry"], e, b)  # noqa: B023  used in this turn only
            return F.struct(carry.cast("double").alias("carry"), F.concat(a["out"], F.array(out.cast("double"))).alias("out"))

        start = F.struct(init.cast("double").alias("carry"), empty.alias("out"))
        o = F.aggregate(source, start, go, lambda a: a["out"])
        outs.append((F.reverse(o) if reverse else o).alias(f"_o_{b}"))
    wide = series.select("y", "x", "s", *outs).select("y", "x", F.posexplode("s").alias("_i", "_e"), *[f"_o_{b}" for b in own])
    cols = [F.col(f"_o_{b}")[F.col("_i")].cast(kind).alias(b) if b in own else F.col(f"_e.{b}").alias(b) for b in cube.bands]
    return cube.having("scan", df=wide.select(F.col("_e.t").alias("t"), "y", "x", *cols), grid=replace(cube.grid, dtype=dtype or dtypes.floating(cube.grid.dtype)))


def ewma(cube: Cube, alpha: float, bands: tuple[str, ...] | None = None) -> Cube:
    """Exponentially weighted mean; missing cells repeat the carry."""
    def body(carry, x):
        new = F.when(x.isNull(), carry).when(carry.isNull(), x).otherwise(alpha * x + (1 - alpha) * carry)
        return new, new

    return scan_over(cube, body, F.lit(None).cast("double"), bands=bands)


def fill_gaps(cube: Cube, method: str = "linear", bands: tuple[str, ...] | None = None) -> Cube:
    """Missing cells from their neighbours in t: ``ffill``, ``bfill`` or ``linear`` by place among the slices, whose ends repeat the nearest.

    Pixels get a row in every slice first.
    """
    cube = every_slice(cube)
    own = tuple(cube.value_bands if bands is None else bands)
    cube._has(own)
    before, after = _pixel().rowsBetween(W.unboundedPreceding, 0), _pixel().rowsBetween(0, W.unboundedFollowing)
    place = F.row_number().over(_pixel())
    df = cube.df.withColumn("_i", place)

    def value(b: str) -> Column:
        v = F.col(b)
        f, n = F.last(v, True).over(before), F.first(v, True).over(after)
        if method == "ffill":
            return f
        if method == "bfill":
            return n
        if method != "linear":
            raise PlanError(f"unknown method {method!r}")
        at = F.when(v.isNotNull(), F.col("_i"))
        back, ahead = F.col("_i") - F.last(at, True).over(before), F.first(at, True).over(after) - F.col("_i")
        mid = F.try_divide(f.cast("double") * ahead + n.cast("double") * back, (back + ahead).cast("double"))
        return F.coalesce(v.cast("double"), mid, f.cast("double"), n.cast("double"))

    dtype = dtypes.floating(cube.grid.dtype) if method == "linear" else cube.grid.dtype
    cols = [value(b).cast(dtypes.spark_type(dtype)).alias(b) if b in own else F.col(b) for b in cube.bands]
    return cube.having(f"fill {method}", df=df.select(*cube.axes, *cols), grid=replace(cube.grid, dtype=dtype))


def hampel_smooth(cube: Cube, k: int = 3, t0: float = 3.0, bands: tuple[str, ...] | None = None) -> Cube:
    """Outliers become their window's median: those further from it than ``t0`` times 1.4826 times the median deviation.

    The window is ``k`` slices each way by place, cut at the ends; missing cells stay missing and are left out.
    """
    own = tuple(cube.value_bands if bands is None else bands)
    w = _pixel().rowsBetween(-k, k)
    cube = every_slice(cube)
    listed = cube.df.select("*", *[F.array_sort(F.collect_list(F.col(b).cast("double")).over(w)).alias(f"_w_{b}") for b in own])

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.try_element_at(s, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2)

    # the median is a column of its own, so that it isn't worked out again for every element of the window
    listed = listed.select("*", *[middle(F.col(f"_w_{b}")).alias(f"_m_{b}") for b in own])

    def value(b: str) -> Column:
        v, med = F.col(b).cast("double"), F.col(f"_m_{b}")
        mad = F.lit(1.4826) * middle(F.array_sort(F.transform(F.col(f"_w_{b}"), lambda x: F.abs(x - med))))
        return F.when(v.isNotNull(), F.when(F.abs(v - med) > t0 * mad, med).otherwise(v))

    cols = [value(b).cast(dtypes.spark_type(dtypes.floating(cube.grid.dtype))).alias(b) if b in own else F.col(b) for b in cube.bands]
    return cube.having("hampel", df=listed.select(*cube.axes, *cols), grid=replace(cube.grid, dtype=dtypes.floating(cube.grid.dtype)))


def local_linear_trend(y: np.ndarray, sigma_lvl: float, sigma_slp: float, sigma_obs: float | np.ndarray, robust_iters: int = 0, robust_threshold: float = 3.0, robust_inflation: float = 100.0, kappa: float = 1e7) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and its standard deviation of ``y`` (series by row), by Kalman filter and Rauch-Tung-Striebel smoother.

    State: level and slope; ``sigma_*`` are standard deviations.  Series with fewer than three values are missing throughout.
    Robust passes inflate the level noise of steps whose innovation exceeds ``robust_threshold`` times the median absolute one.
    """
    n, steps = y.shape
    seen = ~np.isnan(y)
    obs = np.broadcast_to(np.square(sigma_obs), y.shape)
    q_slope = sigma_slp**2
    q_level = np.full((n, steps), float(sigma_lvl) ** 2)
    for turn in range(robust_iters + 1):
        ahead, at, innov = _filtered(y, seen, obs, q_level, q_slope, kappa)
        if turn < robust_iters:
            late = np.cumsum(seen, 1) > 2
            with np.errstate(all="ignore"), warnings.catch_warnings():
                warnings.simplefilter("ignore", RuntimeWarning)
                mad = 1.4826 * np.nanmedian(np.abs(np.where(late, innov, np.nan)), axis=1, keepdims=True)
                jump = np.where(late, np.abs(innov) > robust_threshold * mad, False)
            q_level = np.full((n, steps), float(sigma_lvl) ** 2)
            q_level[:, :-1][jump[:, 1:]] *= robust_inflation
    level, var = np.empty((n, steps)), np.empty((n, steps))
    a0, a1, p00, p01, p11 = (x[-1] for x in at)
    level[:, -1], var[:, -1] = a0, p00
    for t in range(steps - 2, -1, -1):
        f0, f1, f00, f01, f11 = (x[t] for x in at)
        h0, h1, h00, h01, h11 = (x[t + 1] for x in ahead)
        # gain of the smoother: filtered covariance, moved, over the predicted one
        det = h00 * h11 - h01 * h01
        m00, m10 = f00 + f01, f01 + f11
        j00, j01 = (m00 * h11 - f01 * h01) / det, (f01 * h00 - m00 * h01) / det
        j10, j11 = (m10 * h11 - f11 * h01) / det, (f11 * h00 - m10 * h01) / det
        d0, d1, d00, d01, d11 = a0 - h0, a1 - h1, p00 - h00, p01 - h01, p11 - h11
        a0, a1 = f0 + j00 * d0 + j01 * d1, f1 + j10 * d0 + j11 * d1
        p00, p01, p11 = f00 + j00 * j00 * d00 + 2 * j00 * j01 * d01 + j01 * j01 * d11, f01 + j00 * j10 * d00 + (j00 * j11 + j01 * j10) * d01 + j01 * j11 * d11, f11 + j10 * j10 * d00 + 2 * j10 * j11 * d01 + j11 * j11 * d11
        level[:, t], var[:, t] = a0, p00
    few = seen.sum(axis=1) < 3
    sd = np.sqrt(np.maximum(var, 0))
    level[few], sd[few] = np.nan, np.nan
    return level, sd


def _filtered(y: np.ndarray, seen: np.ndarray, obs: np.ndarray, q_level: np.ndarray, q_slope: float, kappa: float) -> tuple[tuple, tuple, np.ndarray]:
    """Predicted and filtered states (level, slope, and their variances and covariance, by step), and standardised innovations."""
    n, steps = y.shape
    ahead, at = (tuple(np.empty((steps, n)) for _ in range(5)) for _ in range(2))
    innov = np.full((n, steps), np.nan)
    a0, a1, p00, p01, p11 = np.zeros(n), np.zeros(n), np.full(n, kappa), np.zeros(n), np.full(n, kappa)
    for t in range(steps):
        if t:
            a0 = a0 + a1
            p00, p01, p11 = p00 + 2 * p01 + p11 + q_level[:, t - 1], p01 + p11, p11 + q_slope
        for x, v in zip(ahead, (a0, a1, p00, p01, p11), strict=True):
            x[t] = v
        s, r = seen[:, t], obs[:, t]
        v, f = np.where(s, y[:, t], 0.0) - a0, p00 + r
        k0, k1 = np.where(s, p00 / f, 0.0), np.where(s, p01 / f, 0.0)
        innov[:, t] = np.where(s, v / np.sqrt(f), np.nan)
        a0, a1 = a0 + k0 * v, a1 + k1 * v
        # Joseph's form keeps the covariance positive
        left = 1 - k0
        p00, p01, p11 = left * left * p00 + k0 * k0 * r, left * (p01 - k1 * p00) + k0 * k1 * r, p11 - 2 * k1 * p01 + k1 * k1 * (p00 + r)
        for x, v in zip(at, (a0, a1, p00, p01, p11), strict=True):
            x[t] = v
    return ahead, at, innov


def by_pixel(cube: Cube, columns: list[str], work: Callable[[np.ndarray, list[str]], np.ndarray], names: list[str], keeps_t: bool) -> DataFrame:
    """``work([pixel, t, column], labels) -> [pixel, (t,) name]`` on batches of pixels; labels are all slices of the cube.

    A pixel's series is gathered in the JVM; a task streams batches of ``PIXELS`` pixels at most, so no
    group of pixels is in memory at once.
    """
    series = cube.df.select("t", "y", "x", *[F.col(c).cast("double").alias(c) for c in columns]).groupBy("y", "x").agg(F.collect_list(F.struct("t", *columns)).alias("s"))
    labels = slices_of(cube).agg(F.sort_array(F.collect_list("t")).alias("_ts"))  # one row
    rows = series.crossJoin(F.broadcast(labels)).select("y", "x", "_ts", F.col("s.t").alias("_t"), *[F.col(f"s.{c}").alias(f"_{i}") for i, c in enumerate(columns)])
    schema = T.StructType(([T.StructField("t", T.StringType())] if keeps_t else []) + [T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(frames):
        for whole in frames:
            for lo in range(0, len(whole), PIXELS):
                f = whole.iloc[lo : lo + PIXELS]
                ts = list(f["_ts"].iloc[0])
                place = {t: i for i, t in enumerate(ts)}
                lens = np.fromiter(map(len, f["_t"]), np.int64, len(f))
                pixel, at = np.repeat(np.arange(len(f)), lens), np.fromiter((place[t] for own in f["_t"] for t in own), np.int64, int(lens.sum()))
                x = np.full((len(f), len(ts), len(columns)), np.nan)
                for i in range(len(columns)):
                    x[pixel, at, i] = np.concatenate([np.asarray(v, float) for v in f[f"_{i}"]])
                made = work(x, ts)
                y, x_ = f["y"].to_numpy(), f["x"].to_numpy()
                out = {"t": np.tile(np.array(ts, object), len(f)), "y": np.repeat(y, len(ts)), "x": np.repeat(x_, len(ts))} if keeps_t else {"y": y, "x": x_}
                for i, n in enumerate(names):
                    out[n] = nullable(made[..., i].ravel())
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def kalman_smooth(cube: Cube, sigma_lvl: float, sigma_slp: float, sigma_obs: float = 1.0, obs_var: str | None = None, outputs: tuple[str, ...] = ("mean", "sd"), bands: tuple[str, ...] | None = None, **robust) -> Cube:
    """Each band's smoothed level (``mean``) and standard deviation (``sd``) as ``<band>_<output>``.

    ``obs_var``: a band of observation variances, in place of ``sigma_obs``.  Steps are all slices of the cube, an absent row is a missing
    value; pixels are smoothed in batches, all of a step at once.
    """
    own = tuple(b for b in (cube.value_bands if bands is None else bands) if b != obs_var)
    names = [f"{b}_{o}" for b in own for o in outputs]
    cols = [*own, *([obs_var] if obs_var else [])]

    def work(x: np.ndarray, ts: list[str]) -> np.ndarray:
        noise = np.sqrt(np.nan_to_num(x[:, :, -1], nan=sigma_obs**2)) if obs_var else sigma_obs
        made = []
        for i, _ in enumerate(own):
            both = dict(zip(("mean", "sd"), local_linear_trend(x[:, :, i], sigma_lvl, sigma_slp, noise, **robust), strict=True))
            made += [both[o] for o in outputs]
        return np.stack(made, axis=-1)

    df = by_pixel(cube, cols, work, names, True)
    return cube.having("kalman", df=df, bands=tuple(names), mask_asset=None, grid=replace(cube.grid, dtype="f64"), dense=True)
