"""Where cubes go."""

from __future__ import annotations

import re
from dataclasses import replace
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dtypes
from ..cube import Cube
from ..errors import WriteError
from ..functions.cells import quantize
from . import tiff

TILE = 1024  # cells along a side of a file


def quantized(cube: Cube, dtype: str, scale: float = 1.0, offset: float = 0.0, nodata: float | None = None) -> Cube:
    """Every band as digital numbers."""
    kind = [quantize(F.col(b), dtype, scale, offset, nodata).alias(b) for b in cube.bands]
    return cube.having(f"quantize {dtype}", df=cube.df.select(*cube.axes, *kind), grid=replace(cube.grid, dtype=dtype))


def materialise(cube: Cube, path: str, overwrite: bool = False) -> Cube:
    """Writes the cube, by slice if it has slices, and reads it lazily again; existing data is refused unless ``overwrite``."""
    w = cube.df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy("t") if "t" in cube.axes else w).parquet(path)
    schema = cube.df.select([c for c in cube.df.columns if c != "t"] + (["t"] if "t" in cube.axes else [])).schema
    return cube.having("materialise", df=cube.df.sparkSession.read.schema(schema).parquet(path).select(*cube.axes, *cube.bands))


def write_groups(cube: Cube, path: str, name: str = "period") -> DataFrame:
    """One folder for each period, unsafe characters as dashes."""
    safe = F.regexp_replace("t", r"[^A-Za-z0-9._-]", "-").alias(name)
    cube.df.select(safe, "y", "x", *cube.bands).write.mode("errorifexists").partitionBy(name).parquet(path)
    return cube.df.sparkSession.read.parquet(path)


def group_path(path: str, label: str) -> str:
    """Path of one group: ``{group}`` or ``{time}`` replaced, or the label put before the extension."""
    safe = re.sub(r"[^A-Za-z0-9._-]", "-", label)
    if "{group}" in path or "{time}" in path:
        return path.replace("{group}", safe).replace("{time}", safe)
    stem, dot, end = path.rpartition(".")
    return f"{stem}-{safe}.{end}" if dot else f"{path}-{safe}"


def write_tif(cube: Cube, path: str, dtype: str | None = None, scale: float | None = None, offset: float = 0.0, nodata: float | None = None, compress: str = "deflate", overviews: int = 0) -> str | list[str]:
    """GeoTIFFs of the bands, one for each slice and tile of ``TILE`` by ``TILE`` cells, written by tasks to a shared folder.

    One path if there are no slices and the grid is one tile, else a list.  With ``scale`` values
    are quantised, which needs an integer type; the file says how to undo it.  Bands keep their names.  ``overviews``: how many
    images of half the size of the one before are added.
    """
    if path.endswith(".vrt"):
        raise WriteError("a VRT is not written to")
    d = dtype or cube.grid.dtype
    whole = d[0] in "iu"
    if scale is not None and not whole:
        raise WriteError("scale needs an integer type")
    if whole:
        lo, hi = dtypes.integer_range(d)
        if nodata is not None and not lo <= nodata <= hi:
            raise WriteError(f"nodata {nodata} does not fit {d}")
        if nodata is None and cube.df.select(F.max(F.greatest(*[F.col(b).isNull().cast("int") for b in cube.bands], F.lit(0)))).first()[0]:
            raise WriteError("missing cells need a nodata value")
        cube = quantized(cube, d, scale or 1.0, offset, nodata)
    grid, bands, sliced = cube.grid, list(cube.bands), "t" in cube.axes
    label = F.col("t").cast("string") if sliced else F.lit("")
    across, down = -(-grid.nx // TILE), -(-grid.ny // TILE)
    cells = cube.df.select(label.alias("t"), F.floor(F.col("y") / TILE).alias("ty"), F.floor(F.col("x") / TILE).alias("tx"), "y", "x", *[F.col(b).cast("double").alias(b) for b in bands])
    # a row without a cell for each tile, so that tiles without cells are written too
    tiles = cube.df.sparkSession.range(across * down).select(F.floor(F.col("id") / across).alias("ty"), (F.col("id") % across).alias("tx"))
    tiles = cells.select("t").distinct().crossJoin(tiles) if sliced else tiles.withColumn("t", F.lit(""))
    rows = cells.unionByName(tiles, allowMissingColumns=True)

    def write(key, f):
        t, ty, tx = key[0], int(key[1]), int(key[2])
        y0, x0 = ty * TILE, tx * TILE
        ny, nx = min(TILE, grid.ny - y0), min(TILE, grid.nx - x0)
        left, w, b, top, c, h = grid.transform
        own = replace(grid, transform=(left + x0 * w, w, b, top + y0 * h, c, h), dims=(("x", nx), ("y", ny)))
        f = f[f["y"].notna()]
        planes = np.full((len(bands), ny, nx), np.nan)
        planes[:, f["y"].to_numpy(int) - y0, f["x"].to_numpy(int) - x0] = f[bands].to_numpy(float).T
        if nodata is not None:
            planes = np.where(np.isnan(planes), nodata, planes)
        elif whole and np.isnan(planes).any():
            raise WriteError("missing cells need a nodata value")
        named = [t] * sliced + [f"y{ty}-x{tx}"] * (across * down > 1)
        to = group_path(path, "-".join(named)) if named else path
        Path(to).write_bytes(tiff.encode(planes, own, d, nodata, bands, scale, offset if scale is not None else None, compress, overviews=overviews))
        return pd.DataFrame({"t": [t], "ty": [ty], "tx": [tx], "path": [to]})

    written = rows.groupBy("t", "ty", "tx").applyInPandas(write, "t string, ty long, tx long, path string").collect()
    paths = [r.path for r in sorted(written)]
    return paths if sliced or across * down > 1 else paths[0]
