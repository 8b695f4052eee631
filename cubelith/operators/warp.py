"""Regridding and points."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import crs, dtypes
from ..cube import Cube
from ..errors import PlanError, WarpUnsupported
from ..grid import GridSpec, grid_equal

#: Methods that weigh neighbours of a place, by how many cells each way.
POINTS = {"near": 1, "bilinear": 2, "cubic": 4, "cubicspline": 4, "lanczos": 6}
#: Methods that gather the cells whose centres a target cell covers.
AREAS = ("average", "mode", "min", "max", "med", "q1", "q3", "sum", "rms")


def _kernel(how: str, d: Column) -> Column:
    """Weight at a distance in cells."""
    a = F.abs(d)
    if how == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    if how == "cubic":  # Catmull-Rom
        return F.when(a <= 1, 1 + a * a * (1.5 * a - 2.5)).when(a < 2, 2 + a * (-4 + a * (2.5 - 0.5 * a))).otherwise(0.0)
    if how == "cubicspline":
        return F.when(a <= 1, 2 / 3 + a * a * (a / 2 - 1)).when(a < 2, (2 - a) * (2 - a) * (2 - a) / 6).otherwise(0.0)
    pi = 3.141592653589793
    return F.when(a < 1e-12, 1.0).when(a < 3, 3 * F.sin(pi * a) * F.sin(pi * a / 3) / (pi * pi * a * a)).otherwise(0.0)


def _places(spark, source: GridSpec, target: GridSpec) -> DataFrame:
    """Each target cell's centre in fractional rows and columns of the source (0.5 is the first cell's centre)."""
    x0, w, _, y0, _, h = target.transform
    cells = spark.range(target.ny * target.nx).select(F.floor(F.col("id") / target.nx).cast("int").alias("y"), (F.col("id") % target.nx).cast("int").alias("x"))
    u, v = crs.transform(target.crs, source.crs, x0 + (F.col("x") + 0.5) * w, y0 + (F.col("y") + 0.5) * h)
    sx, sw, _, sy, _, sh = source.transform
    return cells.select("y", "x", ((v - sy) / sh).alias("r"), ((u - sx) / sw).alias("c"))


def _weighted(cube: Cube, places: DataFrame, keys: list[str], how: str, bands: tuple[str, ...]) -> DataFrame:
    """Values at fractional places (``r``, ``c``) named by ``keys``; missing neighbours share their weight out."""
    n = POINTS[how]
    if how == "near":
        near = places.select(*keys, F.floor("r").cast("int").alias("_y"), F.floor("c").cast("int").alias("_x"), F.lit(1.0).alias("_w"))
    else:
        first = lambda c: F.floor(F.col(c) - 0.5).cast("int") - (n // 2 - 1)
        steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(n)]
        near = places.select(*keys, "r", "c", F.explode(F.array(*steps)).alias("s"))
        near = near.select(*keys, (first("r") + F.col("s.i")).alias("_y"), (first("c") + F.col("s.j")).alias("_x"), "r", "c")
        near = near.withColumn("_w", _kernel(how, F.col("_y") + 0.5 - F.col("r")) * _kernel(how, F.col("_x") + 0.5 - F.col("c"))).where(F.abs("_w") > 1e-12)
    axes = [a for a in cube.axes if a not in ("y", "x")]
    cells = cube.df.select(*axes, F.col("y").alias("_y"), F.col("x").alias("_x"), *bands)
    met = near.join(cells, ["_y", "_x"])
    if how == "near":
        return met.select(*axes, *keys, *bands)
    value = lambda b: F.try_divide(F.sum(F.when(F.col(b).isNotNull(), F.col("_w") * F.col(b).cast("double"))), F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))))
    inside = F.floor(F.col("_r")).between(0, cube.grid.ny - 1) & F.floor(F.col("_c")).between(0, cube.grid.nx - 1)
    named = met.groupBy(*axes, *keys).agg(*[value(b).alias(b) for b in bands], F.first("r").alias("_r"), F.first("c").alias("_c"))
    return named.where(inside).select(*axes, *keys, *bands)


def align(cube: Cube, to: GridSpec | Cube, resampling: str = "bilinear") -> Cube:
    """The cube on another grid; on an equal grid it is returned as it is.  Cells outside the source are missing."""
    target = to.grid if isinstance(to, Cube) else to
    if resampling not in POINTS and resampling not in AREAS:
        raise WarpUnsupported(f"unknown resampling {resampling!r}")
    if grid_equal(cube.grid.spatial(), replace(target.spatial(), dtype=cube.grid.dtype)):
        return cube
    spark, axes = cube.df.sparkSession, [a for a in cube.axes if a not in ("y", "x")]
    grid = replace(cube.grid, crs=target.crs, transform=target.transform, dims=(*target.dims[:2], *cube.grid.dims[2:]))
    bands = cube.bands
    if resampling in POINTS:
        dtype = cube.grid.dtype if resampling == "near" else dtypes.floating(cube.grid.dtype)
        df = _weighted(cube, _places(spark, cube.grid, target), ["y", "x"], resampling, bands)
    else:
        # each source cell's centre falls into one target cell
        dtype = dtypes.floating(cube.grid.dtype)
        x0, w, _, y0, _, h = cube.grid.transform
        u, v = crs.transform(cube.grid.crs, target.crs, x0 + (F.col("x") + 0.5) * w, y0 + (F.col("y") + 0.5) * h)
        tx, tw, _, ty, _, th = target.transform
        home = cube.df.select(*axes, F.floor((v - ty) / th).cast("int").alias("y"), F.floor((u - tx) / tw).cast("int").alias("x"), *bands)
        home = home.where(F.col("y").between(0, target.ny - 1) & F.col("x").between(0, target.nx - 1))
        f = {
            "average": lambda c: F.avg(c),
            "sum": lambda c: F.sum(c),
            "min": lambda c: F.min(c),
            "max": lambda c: F.max(c),
            "med": lambda c: F.percentile(c, 0.5),
            "q1": lambda c: F.percentile(c, 0.25),
            "q3": lambda c: F.percentile(c, 0.75),
            "rms": lambda c: F.sqrt(F.avg(c * c)),
            "mode": lambda c: F.mode(c, True),
        }[resampling]
        df = home.groupBy(*axes, "y", "x").agg(*[f(F.col(b).cast("double")).alias(b) for b in bands])
    kind = dtypes.spark_type(dtype)
    df = df.select(*cube.axes, *[F.col(b).cast(kind).alias(b) for b in bands])
    whole = spark.range(target.ny * target.nx).select(F.floor(F.col("id") / target.nx).cast("int").alias("y"), (F.col("id") % target.nx).cast("int").alias("x"))
    if axes:
        whole = whole.join(F.broadcast(cube.df.select(*axes).distinct()), how="cross")  # slices' labels only
    return cube.having(f"align {resampling}", df=whole.join(df, list(cube.axes), "left").select(*cube.axes, *bands), grid=replace(grid, dtype=dtype))


def extract_points(cube: Cube, points: DataFrame, x: str = "x", y: str = "y", key: str = "id", interp: str = "near", source_crs: str | None = None, bands: tuple[str, ...] | None = None) -> DataFrame:
    """``key`` of each point with the bands' values there (and t, if the cube has it); points outside have missing values."""
    if interp not in POINTS:
        raise WarpUnsupported(f"unknown interpolation {interp!r}")
    own = tuple(cube.bands if bands is None else bands)
    if not {"y", "x"} <= set(cube.axes):
        raise PlanError("x and y were reduced")
    u, v = F.col(x).cast("double"), F.col(y).cast("double")
    if source_crs is not None:
        u, v = crs.transform(source_crs, cube.grid.crs, u, v)
    sx, sw, _, sy, _, sh = cube.grid.transform
    places = points.select(F.col(key).alias(key), ((v - sy) / sh).alias("r"), ((u - sx) / sw).alias("c"))
    found = _weighted(cube, places, [key], interp, own)
    return points.select(key).join(found, key, "left")
