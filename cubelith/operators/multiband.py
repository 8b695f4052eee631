"""Reducers over several bands at once, and projections across bands."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes
from ..cube import Cube
from ..errors import PlanError
from ..functions.tensors import nullable
from .scan import by_pixel


def weiszfeld(x: np.ndarray, iters: int = 12, eps: float = 1e-7) -> np.ndarray:
    """Geometric median of ``[pixel, t, band]``; dates with a missing band have no weight; missing if none is left."""
    ok = ~np.isnan(x).any(axis=2)
    v = np.where(ok[:, :, None], x, 0.0)
    n = ok.sum(axis=1)
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        m = np.nanmean(x, axis=1)
    m = np.where(n[:, None] > 0, np.nan_to_num(m), np.nan)
    for _ in range(iters):
        d = np.sqrt(np.square(v - m[:, None, :]).sum(axis=2))
        w = np.where(ok, 1.0 / (d + eps), 0.0)
        with np.errstate(all="ignore"):
            m = np.einsum("pt,ptb->pb", w, v) / w.sum(axis=1, keepdims=True)
    m[n == 0] = np.nan
    return m


def nearest_observed(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The dates' vector nearest ``m``; the mean of equally near ones."""
    ok = ~np.isnan(x).any(axis=2)
    d = np.where(ok, np.square(np.nan_to_num(x) - np.nan_to_num(m)[:, None, :]).sum(axis=2), np.inf)
    best = ok & (d == d.min(axis=1, keepdims=True))
    with np.errstate(all="ignore"):
        out = np.einsum("pt,ptb->pb", best.astype(float), np.nan_to_num(x)) / best.sum(axis=1, keepdims=True)
    out[~ok.any(axis=1)] = np.nan
    return out


def _by_pixel(cube: Cube, step: str, fn) -> Cube:
    own = cube.value_bands
    df = by_pixel(cube, list(own), lambda x, ts: fn(x), list(own), False)
    return cube.having(step, df=df, bands=own, axes=("y", "x"), mask_asset=None, grid=replace(cube.grid.without("t"), dtype="f64"))


def geomedian(cube: Cube, iters: int = 12, eps: float = 1e-7) -> Cube:
    return _by_pixel(cube, "geomedian", lambda x: weiszfeld(x, iters, eps))


def medoid(cube: Cube, iters: int = 12, eps: float = 1e-7) -> Cube:
    return _by_pixel(cube, "medoid", lambda x: nearest_observed(x, weiszfeld(x, iters, eps)))


def band_project(cube: Cube, weights: dict[str, float], center: dict[str, float] | None = None, name: str = "v") -> Cube:
    """Sum of weight times centred band; missing if any band is."""
    cube._has(weights)
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * (F.col(b).cast("double") - float((center or {}).get(b, 0.0))) for b, w in weights.items()])
    d = dtypes.floating(cube.grid.dtype)
    return cube.having("project", df=cube.df.select(*cube.axes, total.cast(dtypes.spark_type(d)).alias(name)), bands=(name,), mask_asset=None, grid=replace(cube.grid, dtype=d))


def mlp_project(cube: Cube, weights: list[np.ndarray], biases: list[np.ndarray], center=None, scale=None, output_activation: str = "identity", qa_plane: str | None = None, qa_floor: float = 0.0, name: str = "v") -> Cube:
    """Dense layers with ReLU between, one output; missing if a feature is, or if ``qa_plane`` is missing or below ``qa_floor``."""
    own = [b for b in cube.value_bands if b != qa_plane]
    if len(weights) != len(biases) or weights[0].shape[0] != len(own) or weights[-1].shape[1] != 1:
        raise PlanError("the layers do not fit the bands")
    if output_activation not in ("identity", "sigmoid"):
        raise PlanError(f"unknown activation {output_activation!r}")
    shared = cube.df.sparkSession.sparkContext.broadcast(([np.asarray(w, float) for w in weights], [np.asarray(b, float) for b in biases]))
    mid, size = np.zeros(len(own)) if center is None else np.asarray(center, float), np.ones(len(own)) if scale is None else np.asarray(scale, float)

    axes = list(cube.axes)

    def work(frames):
        ws, bs = shared.value
        for f in frames:
            h = (f[own].to_numpy(float) - mid) / size
            for i, (w, b) in enumerate(zip(ws, bs, strict=True)):
                h = h @ w + b
                if i < len(ws) - 1:
                    h = np.where(np.isnan(h), np.nan, np.maximum(h, 0))
            v = h[:, 0]
            if output_activation == "sigmoid":
                v = 1 / (1 + np.exp(-v))
            if qa_plane:
                v = np.where(f[qa_plane].to_numpy(float) >= qa_floor, v, np.nan)
            yield f[axes].assign(**{name: nullable(v)})

    cols = [*own, *([qa_plane] if qa_plane else [])]
    source = cube.df.select(*cube.axes, *[F.col(b).cast("double").alias(b) for b in cols])
    schema = T.StructType([source.schema[a] for a in cube.axes] + [T.StructField(name, T.DoubleType())])
    return cube.having("mlp", df=source.mapInPandas(work, schema), bands=(name,), mask_asset=None, grid=replace(cube.grid, dtype="f64"))
