"""Selection by label, stacking, and datasets from parts."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from .. import dtypes
from ..cube import Cube
from ..errors import GridError, PlanError
from ..grid import grid_diff


def _match(labels: list[str], sel) -> list[str]:
    """Labels by exact match, else by beginning; or by places (from 0) or flags."""
    want = [sel] if isinstance(sel, (str, int)) and not isinstance(sel, bool) else list(sel)
    if want and all(isinstance(w, bool) for w in want):
        if len(want) != len(labels):
            raise PlanError("flags do not fit the axis")
        return [x for x, w in zip(labels, want, strict=True) if w]
    if want and all(isinstance(w, int) for w in want):
        return [labels[i] for i in want]
    exact = [x for x in labels if x in want]
    found = exact or [x for x in labels if any(x.startswith(w) for w in want)]
    if not found:
        raise PlanError(f"nothing matches {sel!r}")
    return found


def time_sel(cube: Cube, sel) -> Cube:
    """Slices by label: exact, else by beginning (``"2023-06"``), or by place.  Strings filter without looking at the data
    if the grid has no labels."""
    labels = cube.grid.labels.get("t")
    if labels is None and (isinstance(sel, str) or all(isinstance(s, str) for s in sel)):
        want = [sel] if isinstance(sel, str) else list(sel)
        keep = reduce(lambda a, b: a | b, [F.startswith(F.col("t"), F.lit(w)) for w in want])
        return cube.having(f"time {sel}", df=cube.df.where(keep))
    if labels is None:
        labels = tuple(r.t for r in cube.df.select("t").distinct().orderBy("t").collect())
    found = _match(list(labels), sel)
    dims = tuple((k, len(found) if k == "t" else n) for k, n in cube.grid.dims)
    grid = replace(cube.grid, dims=dims, labels={**cube.grid.labels, "t": tuple(found)}) if "t" in cube.grid.shape else cube.grid
    return cube.having(f"time {sel}", df=cube.df.where(F.col("t").isin(found)), grid=grid)


def band_sel(cube: Cube, sel) -> Cube:
    return cube.select(*_match(list(cube.bands), sel))


def lazy_stack(cubes: dict[str, Cube] | list[Cube], along: str = "t") -> Cube:
    """Cubes of one grid along a new axis: slices named by their keys, or bands."""
    named = cubes if isinstance(cubes, dict) else {str(i): c for i, c in enumerate(cubes)}
    parts = list(named.values())
    for c in parts[1:]:
        if (what := grid_diff(replace(parts[0].grid, dtype="f32"), replace(c.grid, dtype="f32"))) is not None:
            raise GridError(what)
    dtype = reduce(dtypes.promote, [c.grid.dtype for c in parts])
    grid = replace(parts[0].grid, dtype=dtype).stacked(along, list(named))
    kind = dtypes.spark_type(dtype)
    if along == "t":
        if any("t" in c.axes for c in parts):
            raise GridError("the cubes have slices already")
        bands = parts[0].bands
        rows = [c.df.select(F.lit(t).alias("t"), "y", "x", *[F.col(b).cast(kind).alias(b) for b in bands]) for t, c in named.items()]
        return Cube(reduce(lambda a, b: a.unionByName(b), rows), grid, bands, ("t", "y", "x"), parts[0].mask_asset, (f"stack {len(parts)} slices",))
    on = list(parts[0].axes)
    wide = [c.df.select(*on, F.col(c.bands[0]).cast(kind).alias(b)) for b, c in named.items()]
    return Cube(reduce(lambda a, b: a.join(b, on, "full"), wide), grid, tuple(named), parts[0].axes, None, (f"stack {len(parts)} bands",))


def as_dataset(bands: dict[str, Cube], mask_asset: str | None = None) -> Cube:
    """One cube of one-band cubes; a band may lack slices that another has."""
    first = next(iter(bands.values()))
    on = list(first.axes)
    wide = [c.df.select(*on, F.col(c.bands[0]).alias(b)) for b, c in bands.items()]
    return Cube(reduce(lambda a, b: a.join(b, on, "full"), wide), first.grid, tuple(bands), first.axes, mask_asset, ("dataset",))


def stack_bands(cube: Cube) -> Cube:
    """The bands as an axis of one value column ``v``, labelled by ``band``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in cube.bands])).alias("p")
    df = cube.df.select(*cube.axes, pairs).select(*cube.axes, "p.band", "p.v")
    return Cube(df, cube.grid.stacked("band", list(cube.bands)), ("v",), ("band", *cube.axes), None, (*cube.steps, "stack bands"))
