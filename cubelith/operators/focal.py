"""Neighbourhood operators.

Two paths, chosen by the size of the window (or the option ``focalPath``).  *Cells*: every cell is sent to the neighbours it counts for and summed or compared there with
aggregates, so partial aggregation halves what is shuffled; for few neighbours.  *Tiles*: cells go to square tiles
with a halo, each cell to at most four tiles, and a numpy function works on planes; for wide windows and arbitrary
functions.  Both see missing values outside the raster.

Cells without a row are missing and have no row in the result either, but for functions of the caller: these may
fill a missing cell, so they are given every cell (``present=True`` leaves out those without a row).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dtypes
from ..cube import Cube
from ..errors import FocalPlacement
from ..functions import tensors
from ..plans import options

FEW = 9  # neighbours up to which the cell path is taken by itself


def window(radius: int) -> list[tuple[int, int]]:
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in window(radius) if dy * dy + dx * dx <= radius * radius]


def _check(cube: Cube) -> None:
    if not {"y", "x"} <= set(cube.axes):
        raise FocalPlacement("x and y were reduced")


def _by_tiles(cube: Cube, neighbours: int) -> bool:
    """Whether a neighbourhood goes by tiles: beyond ``FEW`` neighbours, unless the option ``focalPath`` says otherwise."""
    path = options.get(cube.df.sparkSession, "focalPath")
    return path == "tiles" or (path == "auto" and neighbours > FEW)


def _shifted(ok: np.ndarray, radius: int) -> np.ndarray:
    """For each neighbour, whether it has a value; none has outside the plane."""
    return np.stack(tensors.shifts(ok.astype(float), radius)) == 1


def _all_there(ok: np.ndarray, radius: int) -> np.ndarray:
    return _shifted(ok, radius).all(axis=0)


def gather(cube: Cube, offsets: list[tuple[int, int]], make: Callable[[str, Column], Column], bands: tuple[str, ...], extra: list[Column] = (), present: bool = True) -> DataFrame:  # type: ignore[assignment]
    """Per cell aggregates over its neighbours: ``make(band, place)``, where ``place`` numbers the offset of a row."""
    keys = [a for a in cube.axes if a not in ("y", "x")]
    to = F.explode(F.array(*[F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(i).alias("place")) for i, (dy, dx) in enumerate(offsets)])).alias("to")
    sent = cube.df.select(*keys, to, *bands).select(*keys, "to.y", "to.x", "to.place", *bands)
    inside = sent.where(F.col("y").between(0, cube.grid.ny - 1) & F.col("x").between(0, cube.grid.nx - 1))
    own = [F.bool_or(F.col("place") == offsets.index((0, 0))).alias("_own")] if present else []
    out = inside.groupBy(*keys, "y", "x").agg(*[make(b, F.col("place")).alias(b) for b in bands], *extra, *own)
    return out.where("_own").drop("_own") if present else out


def _put(cube: Cube, df: DataFrame, bands: tuple[str, ...], step: str, dtype: str | None = None) -> Cube:
    """``df``'s bands in the place of the cube's; untouched bands are joined back by cell."""
    rest = [b for b in cube.bands if b not in bands]
    kind = dtypes.spark_type(dtype or cube.grid.dtype)
    out = df.select(*cube.axes, *[F.col(b).cast(kind).alias(b) for b in bands])
    if rest:
        out = out.join(cube.df.select(*cube.axes, *rest), list(cube.axes), "left")
    return cube.having(step, df=out.select(*cube.axes, *cube.bands), grid=replace(cube.grid, dtype=dtype or cube.grid.dtype))


def focal(cube: Cube, fn: Callable, radius: int = 1, bands: tuple[str, ...] | None = None, engine: str = "cells", present: bool = False) -> Cube:
    """``fn`` of the ``(2r+1)**2`` shifted values by rows of (dy, dx): Columns (``cells``) or numpy planes (``tiles``)."""
    _check(cube)
    own = tuple(cube.value_bands if bands is None else bands)
    if engine == "tiles":
        return tiles(cube, lambda x: fn(tensors.shifts(x, radius)), radius, own, step=f"focal r={radius}", present=present)
    offsets = window(radius)
    value = lambda b, place: fn([F.max(F.when(place == i, F.col(b))) for i in range(len(offsets))])
    return _put(cube, gather(cube, offsets, value, own, present=present), own, f"focal r={radius}", dtypes.floating(cube.grid.dtype))


def focal_kernel(cube: Cube, weights: np.ndarray, bands: tuple[str, ...] | None = None, engine: str | None = None) -> Cube:
    """Weighted sum of the window; one missing neighbour, also of weight 0, makes the result missing."""
    _check(cube)
    w = np.asarray(weights, float)
    if w.ndim != 2 or w.shape[0] != w.shape[1] or w.shape[0] % 2 == 0:
        raise FocalPlacement("weights must be an odd square")
    own, radius = tuple(cube.value_bands if bands is None else bands), w.shape[0] // 2
    if engine == "tiles" or (engine is None and _by_tiles(cube, w.size)):
        def weighted(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return sum(k * s for k, s in zip(w.ravel(), tensors.shifts(x, radius), strict=True)), _all_there(ok, radius)

        return tiles(cube, weighted, radius, own, step="focal kernel", present=True, masked=True)
    table = F.array(*[F.lit(float(v)) for v in w.ravel()])
    value = lambda b, place: F.when(F.count(b) == w.size, F.sum(F.col(b).cast("double") * table[place]))
    return _put(cube, gather(cube, window(radius), value, own), own, "focal kernel", dtypes.floating(cube.grid.dtype))


def bilateral_focal(cube: Cube, sigma_r: float | dict[str, float], sigma_d: float = 1.0, radius: int = 1, bands: tuple[str, ...] | None = None) -> Cube:
    """Mean weighted by closeness in space and value; missing neighbours are left out, a missing centre stays missing."""
    _check(cube)
    own = tuple(cube.value_bands if bands is None else bands)
    offsets = window(radius)
    if _by_tiles(cube, len(offsets)):
        reach = np.array([np.exp(-(dy * dy + dx * dx) / (2 * sigma_d**2)) for dy, dx in offsets])[:, None, None]

        def smooth(x: np.ndarray, ok: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray]:
            all_, there = np.stack(tensors.shifts(x, radius)), _shifted(ok, radius)
            with np.errstate(all="ignore"):
                w = np.where(there, reach * np.exp(-np.square(all_ - x) / (2 * s * s)), 0.0)
                return np.where(there, w * all_, 0.0).sum(axis=0) / w.sum(axis=0), ok

        out = cube
        for b in own:
            s = sigma_r[b] if isinstance(sigma_r, dict) else sigma_r
            out = tiles(out, lambda x, ok, s=s: smooth(x, ok, s), radius, (b,), step="bilateral", present=True, masked=True)
        return out
    near = F.array(*[F.lit(float(np.exp(-(dy * dy + dx * dx) / (2 * sigma_d**2)))) for dy, dx in offsets])
    centre = offsets.index((0, 0))
    # the window of each cell as an array, its centre beside it
    rows = lambda b, place: F.collect_list(F.when(F.col(b).isNotNull(), F.struct(place.alias("p"), F.col(b).cast("double").alias("v"))))
    mids = [F.max(F.when(F.col("place") == centre, F.col(b).cast("double"))).alias(f"_c_{b}") for b in own]
    df = gather(cube, offsets, rows, own, mids)

    def value(b: str) -> Column:
        s = sigma_r[b] if isinstance(sigma_r, dict) else sigma_r
        c = F.col(f"_c_{b}")
        weight = lambda e: near[e["p"]] * F.exp(-(e["v"] - c) * (e["v"] - c) / (2 * s * s))
        zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
        ratio = F.aggregate(F.array_sort(F.col(b)), zero, lambda a, e: F.struct((a["n"] + weight(e) * e["v"]).alias("n"), (a["d"] + weight(e)).alias("d")), lambda a: F.try_divide(a["n"], a["d"]))
        return F.when(c.isNotNull(), ratio).alias(b)

    return _put(cube, df.select(*cube.axes, *[value(b) for b in own]), own, "bilateral", dtypes.floating(cube.grid.dtype))


def shrink_footprint(cube: Cube, radius: int = 1, bands: tuple[str, ...] | None = None) -> Cube:
    """Missing within ``radius`` (a square) of a missing cell or the border."""
    _check(cube)
    own, n = tuple(cube.value_bands if bands is None else bands), (2 * radius + 1) ** 2
    centre = window(radius).index((0, 0))
    if _by_tiles(cube, n):
        return tiles(cube, lambda x, ok: (x, _all_there(ok, radius)), radius, own, step=f"shrink r={radius}", present=True, masked=True)
    value = lambda b, place: F.when(F.count(b) == n, F.max(F.when(place == centre, F.col(b))))
    return _put(cube, gather(cube, window(radius), value, own), own, f"shrink r={radius}")


def _morph(cube: Cube, band: str, radius: int, grow: bool) -> Cube:
    offsets = disk(radius)
    if _by_tiles(cube, len(offsets)):
        own = [window(radius).index(o) for o in offsets]
        best = np.maximum if grow else np.fmin  # a value that is NaN counts as the largest, as in Spark

        def extreme(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return best.reduce(np.stack(tensors.shifts(x, radius))[own], axis=0), _shifted(ok, radius)[own].all(axis=0)

        return tiles(cube, extreme, radius, (band,), step="dilate" if grow else "erode", present=True, masked=True)
    best = (F.max if grow else F.min)
    value = lambda b, place: F.when(F.count(b) == len(offsets), best(F.col(b)))
    return _put(cube, gather(cube, offsets, value, (band,)), (band,), "dilate" if grow else "erode")


def erode(cube: Cube, band: str, radius: int) -> Cube:
    """Minimum over a disk; missing where the disk meets a missing cell or the border."""
    return _morph(cube, band, radius, False) if radius else cube


def dilate(cube: Cube, band: str, radius: int) -> Cube:
    return _morph(cube, band, radius, True) if radius else cube


def morph_open(cube: Cube, band: str, radius: int) -> Cube:
    return dilate(erode(cube, band, radius), band, radius)


def tiles(cube: Cube, fn: Callable[[np.ndarray], np.ndarray], halo: int, bands: tuple[str, ...] | None = None, size: int | None = None, step: str = "tiles", joint: bool = False, out: tuple[str, ...] | None = None, present: bool = False, masked: bool = False) -> Cube:
    """``fn`` of planes with a halo, cut back to the tile; of all cells, or those with a row if ``present``.

    ``fn`` takes and returns ``[y, x]`` for each band, or ``[band, y, x]`` if ``joint`` (then ``out`` names what it makes).
    Planes hold NaN for missing cells; a NaN it returns is missing.  If ``masked``, missing is told from a value that is
    NaN: ``fn`` of a band also takes a plane that is true where a cell has a value, and returns such a plane beside its own.
    """
    _check(cube)
    own = tuple(cube.value_bands if bands is None else bands)
    made = out or own
    keys = [a for a in cube.axes if a not in ("y", "x")]
    ny, nx = cube.grid.ny, cube.grid.nx
    size = size or options.get(cube.df.sparkSession, "tile")
    if halo >= size:
        raise FocalPlacement("the halo is as wide as a tile")

    def homes(c: str, n: int) -> Column:
        """Tiles along one axis that need a cell."""
        return F.array_distinct(F.array(*[F.floor(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + d)) / size).cast("int") for d in (-halo, 0, halo)]))

    ty, tx = homes("y", ny), homes("x", nx)
    sent = cube.df.select(*keys, "y", "x", *[F.col(b).cast("double").alias(b) for b in own], *[F.col(b).isNotNull().alias(f"_ok_{b}") for b in own if masked]).withColumn("_ty", F.explode(ty)).withColumn("_tx", F.explode(tx))
    schema = T.StructType([cube.df.schema[k] for k in keys] + [T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType())] + [T.StructField(b, T.DoubleType()) for b in made])

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(frame["_ty"].iloc[0]) * size, int(frame["_tx"].iloc[0]) * size
        h, w = min(size, ny - y0), min(size, nx - x0)
        planes = np.full((len(own), h + 2 * halo, w + 2 * halo), np.nan)
        cut = lambda a: a[:, halo : halo + h, halo : halo + w] if a.shape[-2:] != (h, w) else a
        r, c = frame["y"].to_numpy() - y0 + halo, frame["x"].to_numpy() - x0 + halo
        for i, b in enumerate(own):
            planes[i, r, c] = frame[b].to_numpy(float)
        there = None
        if masked:
            ok = np.zeros(planes.shape, bool)
            for i, b in enumerate(own):
                ok[i, r, c] = frame[f"_ok_{b}"].to_numpy(bool)
            got, there = (cut(np.stack(x)) for x in zip(*map(fn, planes, ok), strict=True))
        else:
            got = cut(np.asarray(fn(planes)) if joint else np.stack([fn(p) for p in planes]))
        here = np.full((h + 2 * halo, w + 2 * halo), not present)
        here[r, c] = True
        yy, xx = np.nonzero(here[halo : halo + h, halo : halo + w])
        res = {k: [frame[k].iloc[0]] * len(yy) for k in keys} | {"y": (yy + y0).astype("int32"), "x": (xx + x0).astype("int32")}
        for i, b in enumerate(made):
            res[b] = tensors.nullable(got[i][yy, xx], None if there is None else there[i][yy, xx])
        return pd.DataFrame(res)

    df = sent.groupBy(*keys, "_ty", "_tx").applyInPandas(work, schema)
    kind = dtypes.floating(cube.grid.dtype)
    if out is not None:
        df = df.select(*cube.axes, *[F.col(b).cast(dtypes.spark_type(kind)).alias(b) for b in made])
        return cube.having(step, df=df, bands=made, mask_asset=None, grid=replace(cube.grid, dtype=kind))
    return _put(cube, df, own, step, kind)


def lazy_patch(cube: Cube, fn: Callable[[np.ndarray], np.ndarray], radius: int, out_bands: tuple[str, ...] = ("v",), size: int | None = None) -> Cube:
    """A model over whole windows: ``[band, y, x]`` with a ring of ``radius`` to ``[len(out_bands), y, x]``."""
    return tiles(cube, fn, radius, size=size, step=f"patch r={radius}", joint=True, out=tuple(out_bands))
