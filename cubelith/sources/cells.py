"""Cubes from cell tables, mosaics, and the cubes that the supplied tables make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dtypes
from ..cube import Cube, densify
from ..errors import PlanError
from ..functions.cells import dequantize
from ..grid import GridSpec


def lazy_source(df: DataFrame, grid: GridSpec, band: str = "v", nodata: float | None = None, scale: float | None = None, offset: float | None = None) -> Cube:
    """One band of a cell table (``[t,] y, x, band``).  A sentinel or an affine makes integers f32."""
    touched = nodata is not None or (scale, offset) not in ((None, None), (1.0, 0.0), (1, 0))
    dtype = dtypes.floating(grid.dtype) if touched else grid.dtype
    axes = tuple(a for a in ("t", "y", "x") if a in df.columns)
    value = dequantize(F.col(band), scale or 1.0, offset or 0.0, nodata) if touched else F.nanvl(F.col(band).cast("double"), F.lit(None).cast("double"))
    out = df.select(*axes, value.cast(dtypes.spark_type(dtype)).alias(band))
    from dataclasses import replace

    return Cube(out, replace(grid, dtype=dtype), (band,), axes, None, (f"source {band}",))


def mosaic(df: DataFrame, keys: list[str], bands: list[str], priority: str | Column) -> DataFrame:
    """One row for each cell: of overlapping tiles the last that has a value wins, band by band."""
    p = F.col(priority) if isinstance(priority, str) else priority
    return df.groupBy(*keys).agg(*[F.max_by(F.col(b), F.when(F.col(b).isNotNull(), p)).alias(b) for b in bands])


def lazy_dataset(cells: DataFrame, sources: DataFrame, grid: GridSpec, assets: list[str], mask_asset: str | None = None, sort_field: str = "datetime", nodata: dict[str, float] | None = None, scale: dict[str, float] | None = None, offset: dict[str, float] | None = None, dense: bool = True) -> Cube:
    """A band for each asset and a slice for each date, from a source table with ``slice`` and the tiles' cells.

    ``cells``: ``location, y, x, v``.  Overlapping tiles of a slice: the last by ``sort_field`` (then location) wins.
    The mask band is never scaled.
    """
    if missing := {"slice", "location", "asset", sort_field} - set(sources.columns):
        raise PlanError(f"the source table lacks {sorted(missing)}")
    own = sources.where(F.col("asset").isin(assets)).select("location", "asset", F.col("slice").alias("t"), F.struct(F.col(sort_field), F.col("location")).alias("_p"))
    rows = cells.select("location", "y", "x", F.col("v").cast("double").alias("v")).join(own, "location")

    def value(a: str) -> Column:
        s, o = (1.0, 0.0) if a == mask_asset else ((scale or {}).get(a, 1.0), (offset or {}).get(a, 0.0))
        return F.when(F.col("asset") == a, dequantize(F.col("v"), s, o, (nodata or {}).get(a)))

    wide = rows.select("t", "y", "x", "_p", *[value(a).alias(a) for a in assets])
    df = mosaic(wide, ["t", "y", "x"], assets, "_p")
    if dense:
        df = densify(df, grid, tuple(assets), own.select("t").distinct())
    return Cube(df, grid, tuple(assets), ("t", "y", "x"), mask_asset, (f"dataset of {len(assets)} assets",), dense)


def lazy_stac_stack(cells: DataFrame, sources: DataFrame, grid: GridSpec, asset: str, **params) -> Cube:
    return lazy_dataset(cells, sources, grid, [asset], **params)


# The cubes of the supplied tables


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(nx: int, ny: int, dtype: str = "f64") -> GridSpec:
    return GridSpec("EPSG:3857", (0.0, 10.0, 0.0, 10.0 * ny, 0.0, -10.0), (("x", nx), ("y", ny)), dtype)


def li_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Line items by month on 64 by 64 cells: means of quantity, price, discount and tax, and a quality word of line numbers."""
    d = _read(spark, sf_dir, "lineitem")
    keyed = d.select(F.date_format("l_shipdate", "yyyy-MM").alias("t"), (F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x"), "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("l_linenumber")).alias("bit"))
    # quantities and hundredths are summed as whole numbers, so the order of rows does not matter
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / 100 / F.count(F.lit(1))
    df = keyed.groupBy("t", "y", "x").agg(cents("l_quantity").alias("qty"), cents("l_extendedprice").alias("price"), cents("l_discount").alias("disc"), cents("l_tax").alias("tax"), F.bit_or("bit").cast("double").alias("qa"))
    return Cube(df, _grid(64, 64), ("qty", "price", "disc", "tax", "qa"), ("t", "y", "x"), "qa", ("lineitem",))


#: The same in SQL.
LI_SQL = """li AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS t, CAST(l_orderkey % 64 AS INTEGER) AS y, CAST(l_partkey % 64 AS INTEGER) AS x,
         CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS price,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS disc,
         CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS tax,
         CAST(bit_or(1::BIGINT << l_linenumber) AS DOUBLE) AS qa
  FROM lineitem GROUP BY 1, 2, 3
)"""


def ev_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Events by day on 16 columns of users, dense: the mean value and the number of events."""
    d = _read(spark, sf_dir, "events")
    cents = F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100 / F.count(F.lit(1))
    seen = d.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("t"), F.floor(F.col("user_id") / 16).cast("int").alias("y"), (F.col("user_id") % 16).cast("int").alias("x")).agg(cents.alias("value"), F.count(F.lit(1)).cast("double").alias("n"))
    pixels = d.select(F.floor(F.col("user_id") / 16).cast("int").alias("y"), (F.col("user_id") % 16).cast("int").alias("x")).distinct()
    dense = pixels.join(F.broadcast(seen.select("t").distinct()), how="cross").join(seen, ["t", "y", "x"], "left")  # days only are broadcast
    return Cube(dense.select("t", "y", "x", "value", "n"), _grid(16, 1 << 16), ("value", "n"), ("t", "y", "x"), None, ("events",), True)


EV_SQL = """ev AS (
  WITH s AS (
    SELECT strftime(ts, '%Y-%m-%d') AS t, CAST(user_id // 16 AS INTEGER) AS y, CAST(user_id % 16 AS INTEGER) AS x,
           CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS value, CAST(count(*) AS DOUBLE) AS n
    FROM events GROUP BY 1, 2, 3
  )
  SELECT d.t, p.y, p.x, s.value, s.n FROM (SELECT DISTINCT y, x FROM s) p CROSS JOIN (SELECT DISTINCT t FROM s) d LEFT JOIN s ON s.t = d.t AND s.y = p.y AND s.x = p.x
)"""


def emb_cube(spark: SparkSession, sf_dir: str, bands: int = 8) -> Cube:
    """All embeddings as a raster of 25 columns and as many rows as they take, with a band for each of the first ``bands`` components."""
    d = _read(spark, sf_dir, "embeddings").where("vec_id >= 0")
    ny = (d.agg(F.max("vec_id")).first()[0] or 0) // 25 + 1
    df = d.select(F.floor(F.col("vec_id") / 25).cast("int").alias("y"), (F.col("vec_id") % 25).cast("int").alias("x"), *[F.col("embedding")[i].cast("double").alias(f"b{i + 1}") for i in range(bands)])
    return Cube(df, _grid(25, ny), tuple(f"b{i + 1}" for i in range(bands)), ("y", "x"), None, ("embeddings",))


def emb_sql(bands: int = 8) -> str:
    columns = ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS b{i}" for i in range(1, bands + 1))
    return f"emb AS (SELECT CAST(vec_id // 25 AS INTEGER) AS y, CAST(vec_id % 25 AS INTEGER) AS x, {columns} FROM embeddings WHERE vec_id >= 0)"


EMB_SQL = emb_sql()


def src_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a source table: priorities are assets, a customer's number places the footprint."""
    o = _read(spark, sf_dir, "orders")
    x, y = (F.col("o_custkey") % 36 * 10 - 180).cast("double"), (F.floor(F.col("o_custkey") / 36) % 17 * 10 - 85).cast("double")
    return o.select(
        F.concat(F.lit("item-"), F.col("o_orderkey").cast("string")).alias("item_id"),
        F.col("o_orderpriority").alias("asset"),
        F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("location"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:30:00Z")).alias("datetime"),
        F.when(F.col("o_orderkey") % 17 != 0, F.floor(F.col("o_totalprice")) % 100).cast("double").alias("cloud_cover"),
        x.alias("xmin"), y.alias("ymin"), (x + 10).alias("xmax"), (y + 10).alias("ymax"),
    )


SRC_SQL = """src AS (
  SELECT 'item-' || o_orderkey AS item_id, o_orderpriority AS asset, '/data/' || o_orderkey || '.tif' AS location,
         strftime(o_orderdate, '%Y-%m-%d') || 'T10:30:00Z' AS datetime,
         CAST(CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 100 END AS DOUBLE) AS cloud_cover,
         CAST(o_custkey % 36 * 10 - 180 AS DOUBLE) AS xmin, CAST(o_custkey // 36 % 17 * 10 - 85 AS DOUBLE) AS ymin,
         CAST(o_custkey % 36 * 10 - 170 AS DOUBLE) AS xmax, CAST(o_custkey // 36 % 17 * 10 - 75 AS DOUBLE) AS ymax
  FROM orders
)"""
