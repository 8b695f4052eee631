"""Lazy cubes: a wide DataFrame of cells with its grid.

A row is a cell: ``t`` (a slice's label), ``y`` and ``x`` (row and column from 0) and one
column for each band.  Axes that were reduced have no column.  A missing row and a NULL both mean
missing; sources give all cells of their footprint.  Nothing is computed before an action.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dtypes
from .errors import GridError, PlanError
from .functions import nodata as nd
from .grid import GridSpec, grid_diff, spatial_equal


@dataclass(frozen=True)
class Cube:
    """``df`` has the columns of ``axes`` and of ``bands``; ``mask_asset`` is a band that value operations leave alone.

    ``dense``: every pixel that has a row has one in each slice, so places along t are places among its rows.
    """

    df: DataFrame
    grid: GridSpec
    bands: tuple[str, ...]
    axes: tuple[str, ...] = ("t", "y", "x")
    mask_asset: str | None = None
    steps: tuple[str, ...] = ()
    dense: bool = False

    def __post_init__(self):
        object.__setattr__(self, "bands", tuple(self.bands))
        missing = [c for c in (*self.axes, *self.bands) if c not in self.df.columns]
        if missing:
            raise PlanError(f"the cube has no columns {missing}")

    # -- parts

    @property
    def value_bands(self) -> tuple[str, ...]:
        return tuple(b for b in self.bands if b != self.mask_asset)

    def having(self, step: str, **changes) -> Cube:
        """A copy with changes, and the step in its log."""
        return replace(self, steps=(*self.steps, step), **changes)

    def with_values(self, step: str, make, bands: tuple[str, ...] | None = None, dtype: str | None = None) -> Cube:
        """Every value band (or those of ``bands``) replaced by ``make(column)``."""
        own = self.value_bands if bands is None else tuple(bands)
        self._has(own)
        kind = dtypes.spark_type(dtype or self.grid.dtype)
        out = [make(F.col(b)).cast(kind).alias(b) if b in own else F.col(b) for b in self.bands]
        return self.having(step, df=self.df.select(*self.axes, *out), grid=replace(self.grid, dtype=dtype or self.grid.dtype))

    def _has(self, bands) -> None:
        if wrong := [b for b in bands if b not in self.bands]:
            raise PlanError(f"no such bands: {wrong}")

    def select(self, *bands: str) -> Cube:
        """Some bands; the mask band stays a mask only if it is among them."""
        self._has(bands)
        return self.having(f"select {', '.join(bands)}", df=self.df.select(*self.axes, *bands), bands=bands, mask_asset=self.mask_asset if self.mask_asset in bands else None)

    def __getitem__(self, key) -> Cube:
        return self.select(*([key] if isinstance(key, str) else key))

    def with_band(self, name: str, value: Column | Cube, dtype: str | None = None) -> Cube:
        """A band more (or replaced), from an expression on bands or from a one-band cube on the same spatial grid."""
        keep_ = [b for b in self.bands if b != name]
        if isinstance(value, Cube):
            if not spatial_equal(self.grid, value.grid):
                raise GridError(grid_diff(self.grid.spatial(), value.grid.spatial()))
            if len(value.bands) != 1:
                raise PlanError("a band is assigned from a cube of one band")
            on = [a for a in value.axes if a in self.axes]
            other = value.df.select(*on, F.col(value.bands[0]).alias(name))
            df = self.df.select(*self.axes, *keep_).join(other, on, "left")
        else:
            df = self.df.select(*self.axes, *keep_, value.cast(dtypes.spark_type(dtype or self.grid.dtype)).alias(name))
        return self.having(f"band {name}", df=df.select(*self.axes, *keep_, name), bands=(*keep_, name))

    # -- arithmetic: scalars touch value bands; cubes of one grid meet cell by cell in the bands both have

    def _scalar(self, name: str, f, v, division: bool = False, keeps: bool = True) -> Cube:
        d = dtypes.with_scalar(self.grid.dtype, v, division or not keeps)
        return self.with_values(f"{name} {v}", f, dtype=d)

    def _both(self, name: str, f, other: Cube, division: bool = False) -> Cube:
        if (what := grid_diff(replace(self.grid, dtype="f32"), replace(other.grid, dtype="f32"))) is not None:
            raise GridError(f"grids differ; align one first: {what}")
        if self.axes != other.axes:
            raise PlanError(f"axes differ: {self.axes} and {other.axes}")
        shared = [b for b in self.value_bands if b in other.value_bands]
        if not shared:
            raise PlanError("no band in common")
        d = dtypes.promote(self.grid.dtype, other.grid.dtype, division)
        a = self.df.select(*self.axes, *[F.col(b).alias(f"a_{i}") for i, b in enumerate(shared)])
        b = other.df.select(*other.axes, *[F.col(b).alias(f"b_{i}") for i, b in enumerate(shared)])
        both = a.join(b, list(self.axes)) if self.axes else a.crossJoin(b)
        out = [f(F.col(f"a_{i}"), F.col(f"b_{i}")).cast(dtypes.spark_type(d)).alias(n) for i, n in enumerate(shared)]
        return self.having(name, df=both.select(*self.axes, *out), bands=tuple(shared), mask_asset=None, grid=replace(self.grid, dtype=d), dense=self.dense and other.dense)

    def _binary(self, name: str, f, other, division: bool = False, flip: bool = False) -> Cube:
        g = (lambda a, b: f(b, a)) if flip else f
        if isinstance(other, Cube):
            return self._both(name, g, other, division)
        return self._scalar(name, lambda c: g(c, F.lit(other)), other, division)

    def __add__(self, o):
        return self._binary("+", lambda a, b: nd.clean(a + b) if self.grid.dtype[0] == "f" else a + b, o)

    __radd__ = __add__

    def __sub__(self, o):
        return self._binary("-", lambda a, b: nd.clean(a - b) if self.grid.dtype[0] == "f" else a - b, o)

    def __rsub__(self, o):
        return self._binary("-", lambda a, b: a - b, o, flip=True)

    def __mul__(self, o):
        return self._binary("*", lambda a, b: nd.clean(a * b) if self.grid.dtype[0] == "f" else a * b, o)

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._binary("/", nd.divide, o, division=True)

    def __rtruediv__(self, o):
        return self._binary("/", nd.divide, o, division=True, flip=True)

    def __pow__(self, o):
        return self._binary("^", nd.power, o, division=True)

    def __mod__(self, o):
        return self._binary("%%", nd.modulo, o)

    def __neg__(self):
        return self * -1

    def _compare(self, how: str, o) -> Cube:
        f = lambda a, b: nd.compare(how, a, b)
        if isinstance(o, Cube):
            out = self._both(how, f, o)
            return replace(out, df=out.df.select(*out.axes, *[F.col(b).cast("float").alias(b) for b in out.bands]), grid=replace(out.grid, dtype="f32"))
        return self.with_values(f"{how} {o}", lambda c: f(c, F.lit(o)), dtype="f32")

    def __lt__(self, o):
        return self._compare("<", o)

    def __le__(self, o):
        return self._compare("<=", o)

    def __gt__(self, o):
        return self._compare(">", o)

    def __ge__(self, o):
        return self._compare(">=", o)

    def __eq__(self, o):  # type: ignore[override]
        return self._compare("==", o)

    def __ne__(self, o):  # type: ignore[override]
        return self._compare("!=", o)

    __hash__ = None

    def math(self, name: str, *args) -> Cube:
        """A function of the Math group by name, on every value band."""
        if name.startswith("cum"):
            raise PlanError(f"{name} runs along an axis: use scan_over")
        if name not in nd.MATH:
            raise PlanError(f"unknown function {name!r}")
        d = self.grid.dtype if name in nd.KEEPS else dtypes.floating(self.grid.dtype)
        return self.with_values(name, lambda c: nd.MATH[name](c, *args), dtype=d)

    def map(self, fn, *others: Cube, dtype: str | None = None, bands: tuple[str, ...] | None = None) -> Cube:
        """``fn`` of each value band's column, and of the columns of one-band ``others`` on the same spatial grid.

        A plane (without t) meets every slice.
        """
        df, extra = self.df, []
        for i, o in enumerate(others):
            if not spatial_equal(self.grid, o.grid):
                raise GridError(grid_diff(self.grid.spatial(), o.grid.spatial()))
            name = f"_o{i}"
            on = [a for a in o.axes if a in self.axes]
            df = df.join(o.df.select(*on, F.col(o.bands[0]).alias(name)), on, "left")
            extra.append(F.col(name))
        wide = replace(self, df=df)
        return wide.with_values("map", lambda c: fn(c, *extra), bands, dtype)

    # -- actions

    def collect(self) -> np.ndarray | dict[str, np.ndarray] | float:
        """A number, ``[y, x]`` or ``(y, x, band)``; with t a dict of these by label.  For results that fit the driver."""
        if not set(self.axes) & {"y", "x"} and "t" not in self.axes:
            row = self.df.select(*self.bands).first()
            return float(row[0]) if len(self.bands) == 1 else {b: row[b] for b in self.bands}
        got = self.df.select(*self.axes, *[F.col(b).cast("double").alias(b) for b in self.bands]).toPandas()
        by = {t: g for t, g in got.groupby("t")} if "t" in self.axes else {"": got}
        out = {}
        for t, g in by.items():
            if "y" not in self.axes:
                out[t] = g[list(self.bands)].to_numpy(float)[0]
                continue
            a = np.full((self.grid.ny, self.grid.nx, len(self.bands)), np.nan)
            a[g["y"].to_numpy(), g["x"].to_numpy()] = g[list(self.bands)].to_numpy(float)
            out[t] = a[:, :, 0] if len(self.bands) == 1 else a
        return out if "t" in self.axes else out[""]

    @property
    def gis(self) -> dict:
        """What goes beside a collected array."""
        return {"bbox": self.grid.extent, "dim": (self.grid.nx, self.grid.ny, len(self.bands)), "srs": self.grid.crs, "datatype": self.grid.dtype}

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)


#: Labels of slices up to which they may meet every pixel.
SLICES = 1_000_000


def slices_of(cube: Cube) -> DataFrame:
    """``t`` of the cube's slices; small, and checked to be when it is broadcast."""
    spark, labels = cube.df.sparkSession, cube.grid.labels.get("t")
    if labels is not None:
        return spark.createDataFrame([(t,) for t in labels], "t string")
    return cube.df.select("t").distinct()


def every_slice(cube: Cube) -> Cube:
    """The cube with a row in each slice for every pixel that has a row at all."""
    if cube.dense or "t" not in cube.axes:
        return cube
    place = [a for a in cube.axes if a != "t"]
    listed = slices_of(cube).agg(F.sort_array(F.collect_list("t")).alias("_ts"))
    checked = listed.select(F.when(F.size("_ts") > SLICES, F.raise_error(F.lit("too many slices to fill in")).cast("array<string>")).otherwise(F.col("_ts")).alias("_ts"))
    pixels = cube.df.select(*place).distinct().crossJoin(F.broadcast(checked)).select(*place, F.explode("_ts").alias("t"))
    return cube.having("every slice", df=pixels.join(cube.df, list(cube.axes), "left").select(*cube.axes, *cube.bands), dense=True)


def ifelse(cond: Column, yes, no) -> Column:
    from .functions.cells import ifelse as f

    return f(cond, yes, no)


def densify(df: DataFrame, grid: GridSpec, bands: tuple[str, ...], slices: DataFrame | None = None) -> DataFrame:
    """All cells of the grid (times the slices of ``slices``), with the observations where there are any."""
    spark = df.sparkSession
    cells = spark.range(grid.ny * grid.nx).select(F.floor(F.col("id") / grid.nx).cast("int").alias("y"), (F.col("id") % grid.nx).cast("int").alias("x"))
    keys = ["y", "x"]
    if slices is not None:  # labels of slices only; each is asked for every cell
        cells, keys = cells.join(F.broadcast(slices.select("t")), how="cross"), ["t", "y", "x"]
    return cells.join(df, keys, "left").select(*keys, *bands)
