"""The engine's queries over the supplied tables, each with the same in SQL where SQL can say it.

Values are rounded to 6 digits on both sides, after a billionth has been added: means of whole hundredths often end in a 5 in
the seventh place, which the order of a sum would round either way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cube import Cube
from .functions import cells as g
from .functions import nodata as nd
from .grid import GridSpec
from .operators import focal as fo
from .operators import gradient, multiband, scan, select, warp
from .operators.mask import mask
from .operators.reduce import NAMES, group_by_time, period, reduce_over
from .sources import sinks, stac
from .sources.cells import EMB_SQL, EV_SQL, LI_SQL, SRC_SQL, emb_cube, emb_sql, ev_cube, lazy_dataset, lazy_source, li_cube, mosaic, src_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _r(df: DataFrame | Cube) -> DataFrame:
    """Fractions to 6 digits, without a negative zero."""
    df = df.df if isinstance(df, Cube) else df
    return df.select(*[(F.round(F.col(c).cast("double") + F.lit(1e-9), 6) + F.lit(0.0)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def _add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def _s(expr: str) -> str:
    """The rounding of ``_r``."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, 6) + 0.0"


MASKED = "m AS (SELECT t, y, x, CASE WHEN CAST(qa AS BIGINT) & 6 > 0 THEN NULL ELSE qty END AS qty, CASE WHEN CAST(qa AS BIGINT) & 6 > 0 THEN NULL ELSE price END AS price, CASE WHEN CAST(qa AS BIGINT) & 6 > 0 THEN NULL ELSE disc END AS disc, CASE WHEN CAST(qa AS BIGINT) & 6 > 0 THEN NULL ELSE tax END AS tax FROM li)"


def _masked(spark: SparkSession, d: str) -> Cube:
    return mask(li_cube(spark, d), where=g.qa_bits(1, 2))


@_add("composite", f"WITH {LI_SQL}, {MASKED}, c AS (SELECT y, x, median(price) AS price, median(qty) AS qty FROM m GROUP BY y, x) SELECT y, x, {_s('price')} AS price, {_s('qty')} AS qty, {_s('(price - qty) / (price + qty)')} AS ratio FROM c")
def composite(spark, d):
    """Quality-masked median composite with a derived ratio: the flagship."""
    c = reduce_over(_masked(spark, d).select("price", "qty"), "median", "t")
    ratio = nd.divide(F.col("price") - F.col("qty"), F.col("price") + F.col("qty"))
    return _r(c.with_band("ratio", ratio))


_RED = {"sum": "coalesce(sum({0}), 0)", "mean": "avg({0})", "min": "coalesce(min({0}), 'inf'::DOUBLE)", "max": "coalesce(max({0}), '-inf'::DOUBLE)", "count": "CAST(count({0}) AS INTEGER)", "median": "median({0})", "quantile": "quantile_cont({0}, 0.25)", "sd": "stddev_samp({0})", "var": "var_samp({0})", "any": "coalesce(bool_or({0} <> 0), false)", "all": "coalesce(bool_and({0} <> 0), true)", "prod": "coalesce(product({0} / 25), 1)"}


def _reduction(op: str) -> None:
    e = _RED[op].format("qty")
    e = e if op in ("count", "any", "all") else _s(e)

    @_add(f"reduce_{op}_t", f"WITH {LI_SQL}, {MASKED} SELECT y, x, {e} AS qty FROM m GROUP BY y, x")
    def run(spark, d, op=op):
        c = _masked(spark, d).select("qty")
        return _r(reduce_over(c / 25 if op == "prod" else c, op, "t", q=0.25))


for _op in NAMES:
    _reduction(_op)


@_add("reduce_poisoned", f"WITH {LI_SQL}, {MASKED} SELECT y, x, {_s('CASE WHEN count(tax) = (SELECT count(DISTINCT t) FROM li) THEN avg(tax) END')} AS tax FROM m GROUP BY y, x")
def reduce_poisoned(spark, d):
    return _r(reduce_over(_masked(spark, d).select("tax"), "mean", "t", nan_rm=False))


@_add("reduce_xy", f"WITH {LI_SQL}, {MASKED} SELECT t, {_s('avg(qty)')} AS qty, {_s('avg(disc)')} AS disc FROM m GROUP BY t")
def reduce_xy(spark, d):
    return _r(reduce_over(_masked(spark, d).select("qty", "disc"), "mean", ("x", "y")))


@_add("reduce_all", f"WITH {LI_SQL}, {MASKED} SELECT CAST(count(qty) AS INTEGER) AS qty, CAST(count(disc) AS INTEGER) AS disc FROM m")
def reduce_all(spark, d):
    return _r(reduce_over(_masked(spark, d).select("qty", "disc"), "count", ("t", "x", "y")))


_ALL = "[" + ", ".join(f"b{i}" for i in range(1, 65)) + "]"


@_add("reduce_band", f"WITH {emb_sql(64)} SELECT y, x, {_s(f'list_avg({_ALL})')} AS v FROM emb")
def reduce_band(spark, d):
    return _r(reduce_over(emb_cube(spark, d, 64), "mean", "band"))


@_add("reduce_band_median", f"WITH {emb_sql(64)} SELECT y, x, {_s(f'list_median({_ALL})')} AS v FROM emb")
def reduce_band_median(spark, d):
    return _r(reduce_over(emb_cube(spark, d, 64), "median", "band"))


@_add("reduce_custom", f"WITH {LI_SQL} SELECT y, x, {_s('max(qty) - min(qty)')} AS qty FROM li GROUP BY y, x")
def reduce_custom(spark, d):
    return _r(reduce_over(li_cube(spark, d).select("qty"), lambda a: F.array_max(a) - F.array_min(a), "t"))


_PERIOD = {"year": "strftime({0}, '%Y')", "quarter": "strftime({0}, '%Y') || '-Q' || quarter({0})", "month": "strftime({0}, '%Y-%m')", "week": "strftime({0}, '%G-W%V')", "day": "strftime({0}, '%Y-%m-%d')"}


def _calendar(by: str) -> None:
    e = _PERIOD[by].format("CAST(t AS DATE)")

    @_add(f"group_by_{by}", f"WITH {EV_SQL} SELECT {e} AS t, y, x, {_s('avg(value)')} AS value, {_s('avg(n)')} AS n FROM ev GROUP BY {e}, y, x")
    def run(spark, d, by=by):
        return _r(group_by_time(ev_cube(spark, d), by).reduce_over("mean"))


for _by in _PERIOD:
    _calendar(_by)


@_add("time_sel", f"WITH {LI_SQL} SELECT t, y, x, {_s('qty')} AS qty FROM li WHERE t LIKE '1996-%'")
def time_sel(spark, d):
    return _r(select.time_sel(li_cube(spark, d).select("qty"), "1996"))


@_add("band_sel", f"WITH {emb_sql(64)} SELECT y, x, {_s('b3')} AS b3, {_s('b64')} AS b64 FROM emb")
def band_sel(spark, d):
    return _r(select.band_sel(emb_cube(spark, d, 64), [2, 63]))


@_add("arithmetic", f"WITH {EMB_SQL} SELECT y, x, {_s('(b1 + 2) * 3 - 1')} AS b1, {_s('(b2 + 2) * 3 - 1')} AS b2 FROM emb")
def arithmetic(spark, d):
    return _r((emb_cube(spark, d).select("b1", "b2") + 2) * 3 - 1)


@_add("cube_arithmetic", f"WITH {LI_SQL}, a AS (SELECT y, x, avg(price) AS price, avg(disc) AS disc FROM li GROUP BY y, x), b AS (SELECT y, x, max(price) AS price, max(disc) AS disc FROM li GROUP BY y, x) SELECT y, x, {_s('a.price / b.price / 7')} AS price, {_s('CASE WHEN b.disc <> 0 THEN a.disc / b.disc / 7 END')} AS disc FROM a JOIN b USING (y, x)")
def cube_arithmetic(spark, d):
    li = li_cube(spark, d).select("price", "disc")
    return _r(reduce_over(li, "mean", "t") / reduce_over(li, "max", "t") / 7)


@_add("comparison", f"WITH {EV_SQL} SELECT t, y, x, CAST(coalesce(CASE WHEN value > 100 THEN 1 ELSE 0 END, 0) AS DOUBLE) AS value, CAST(coalesce(CASE WHEN n > 100 THEN 1 ELSE 0 END, 0) AS DOUBLE) AS n FROM ev")
def comparison(spark, d):
    return _r(ev_cube(spark, d) > 100)


@_add("unequal", f"WITH {EV_SQL} SELECT t, y, x, CAST(CASE WHEN n = 1 THEN 0 ELSE 1 END AS DOUBLE) AS n FROM ev")
def unequal(spark, d):
    return _r(ev_cube(spark, d).select("n") != 1)


@_add("math_group", f"WITH {EMB_SQL} SELECT y, x, {_s('abs(b1)')} AS a_abs, {_s('CASE WHEN b1 > 0 THEN ln(b1) END')} AS a_log, {_s('exp(b1)')} AS a_exp, {_s('CASE WHEN b1 >= 0 THEN sqrt(b1) END')} AS a_sqrt, {_s('floor(b1 * 10)')} AS a_floor, {_s('sin(b1) + cos(b1) * tan(b1)')} AS a_trig, {_s('atan(b1)')} AS a_atan, {_s('CASE WHEN b1 > 0 THEN lgamma(b1) END')} AS a_lgamma FROM emb")
def math_group(spark, d):
    c = emb_cube(spark, d)
    b, m = F.col("b1"), nd.MATH
    out = c.df.select("y", "x", m["abs"](b).alias("a_abs"), m["log"](b).alias("a_log"), m["exp"](b).alias("a_exp"), m["sqrt"](b).alias("a_sqrt"), m["floor"](b * 10).alias("a_floor"), (m["sin"](b) + m["cos"](b) * m["tan"](b)).alias("a_trig"), m["atan"](b).alias("a_atan"), F.when(b > 0, m["lgamma"](b)).alias("a_lgamma"))
    return _r(out)


@_add("power_modulo", f"WITH {EMB_SQL} SELECT y, x, {_s('CASE WHEN b1 >= 0 THEN pow(b1, 1.5) END')} AS p, {_s('b1 * 10 - floor(b1 * 10 / -3) * -3')} AS m FROM emb")
def power_modulo(spark, d):
    b = F.col("b1")
    return _r(emb_cube(spark, d).df.select("y", "x", nd.power(b, 1.5).alias("p"), nd.modulo(b * 10, F.lit(-3)).alias("m")))


@_add("bitwise", f"WITH {LI_SQL} SELECT t, y, x, CAST(qa AS BIGINT) & 12 AS a, CAST(qa AS BIGINT) | 1 AS o, xor(CAST(qa AS BIGINT), 255) AS e, CAST(qa AS BIGINT) << 2 AS l, CAST(qa AS BIGINT) >> 1 AS r FROM li")
def bitwise(spark, d):
    q = F.col("qa").cast("long")
    return li_cube(spark, d).df.select("t", "y", "x", g.bit_and(q, 12).alias("a"), g.bit_or(q, 1).alias("o"), g.bit_xor(q, 255).alias("e"), g.shift_left(q, 2).alias("l"), g.shift_right(q, 1).alias("r"))


@_add("quantize", f"WITH {EMB_SQL} SELECT y, x, CAST(greatest(-127, least(127, round_even(b1 / 0.004, 0))) AS SMALLINT) AS b1 FROM emb")
def quantize(spark, d):
    c = emb_cube(spark, d).select("b1")
    return c.df.select("y", "x", g.clamp(g.quantize(F.col("b1"), "i16", scale=0.004), -127, 127).cast("short").alias("b1"))


@_add("dequantize", f"WITH {LI_SQL} SELECT t, y, x, {_s('(qty / 127.5) * abs(qty / 127.5)')} AS aef, {_s('((CAST(floor(qty / 8) AS BIGINT) % 8) - 4) / 4.0')} AS esd FROM li")
def dequantize(spark, d):
    return _r(li_cube(spark, d).df.select("t", "y", "x", g.dequantize_aef(F.col("qty")).alias("aef"), g.dequantize_esd(F.col("qty"), 1).alias("esd")))


@_add("derived_band", f"WITH {EMB_SQL} SELECT y, x, {_s('b1')} AS b1, {_s('CASE WHEN b1 > 0 THEN b2 ELSE b3 END')} AS pick FROM emb")
def derived_band(spark, d):
    return _r(emb_cube(spark, d).with_band("pick", g.ifelse(F.col("b1") > 0, F.col("b2"), F.col("b3"))).select("b1", "pick"))


@_add("map_plane", f"WITH {LI_SQL}, p AS (SELECT y, x, avg(qty) AS p FROM li GROUP BY y, x) SELECT t, y, x, {_s('qty - p')} AS qty FROM li LEFT JOIN p USING (y, x)")
def map_plane(spark, d):
    c = li_cube(spark, d).select("qty")
    return _r(c.map(lambda v, p: v - p, reduce_over(c, "mean", "t")))


@_add("mask_slices", f"WITH {LI_SQL} SELECT t, y, x, {_s('CASE WHEN qa IN (2, 4) THEN NULL ELSE qty END')} AS qty FROM li WHERE t LIKE '1996-%'")
def mask_slices(spark, d):
    """A mask from another cube, where both have slices."""
    c = li_cube(spark, d)
    return _r(mask(c.select("qty"), select.time_sel(c.select("qa"), "1996"), [2.0, 4.0], join="inner"))


@_add("mask_values", f"WITH {LI_SQL} SELECT t, y, x, {_s('CASE WHEN qa IN (2, 4) THEN NULL ELSE qty END')} AS qty FROM li")
def mask_values(spark, d):
    return _r(mask(li_cube(spark, d).select("qty", "qa"), "qa", [2.0, 4.0]))


_N9 = "n AS (SELECT a.y, a.x, count(b.b1) AS k, sum(b.b1) AS s, min(b.b1) AS lo, max(b.b1) AS hi FROM emb a JOIN emb b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.y, a.x)"


@_add("focal_mean", f"WITH {EMB_SQL}, {_N9} SELECT y, x, {_s('CASE WHEN k = 9 THEN s / 9 END')} AS b1 FROM n")
def focal_mean(spark, d):
    return _r(fo.focal_kernel(emb_cube(spark, d).select("b1"), np.full((3, 3), 1 / 9)))


@_add("focal_mean_tiles", f"WITH {EMB_SQL}, {_N9} SELECT y, x, {_s('CASE WHEN k = 9 THEN s / 9 END')} AS b1 FROM n")
def focal_mean_tiles(spark, d):
    return _r(fo.focal_kernel(emb_cube(spark, d).select("b1"), np.full((3, 3), 1 / 9), engine="tiles"))


@_add("focal_range", f"WITH {EMB_SQL}, {_N9} SELECT y, x, {_s('hi - lo')} AS b1 FROM n")
def focal_range(spark, d):
    return _r(fo.focal(emb_cube(spark, d).select("b1"), lambda s: F.greatest(*s) - F.least(*s), present=True))


@_add("shrink_footprint", f"WITH {EMB_SQL}, {_N9} SELECT y, x, {_s('CASE WHEN k = 9 THEN b1 END')} AS b1 FROM n JOIN emb USING (y, x)")
def shrink_footprint(spark, d):
    return _r(fo.shrink_footprint(emb_cube(spark, d).select("b1")))


@_add("morphology", f"WITH {EMB_SQL}, b AS (SELECT y, x, CAST(b1 > 0 AS INTEGER) AS b1 FROM emb), e AS (SELECT a.y, a.x, CASE WHEN count(*) = 5 THEN min(c.b1) END AS b1 FROM b a JOIN b c ON abs(c.y - a.y) + abs(c.x - a.x) <= 1 GROUP BY a.y, a.x), d AS (SELECT a.y, a.x, CASE WHEN count(c.b1) = 5 THEN max(c.b1) END AS b1 FROM e a JOIN e c ON abs(c.y - a.y) + abs(c.x - a.x) <= 1 GROUP BY a.y, a.x) SELECT y, x, {_s('b1')} AS b1 FROM d")
def morphology(spark, d):
    return _r(fo.morph_open(emb_cube(spark, d).select("b1") > 0, "b1", 1))


@_add("bilateral", f"WITH {EMB_SQL}, w AS (SELECT a.y, a.x, b.b1 AS v, exp(-((b.y - a.y) * (b.y - a.y) + (b.x - a.x) * (b.x - a.x)) / 2.0) * exp(-(b.b1 - a.b1) * (b.b1 - a.b1) / (2 * 0.25)) AS w FROM emb a JOIN emb b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1) SELECT y, x, {_s('sum(w * v) / sum(w)')} AS b1 FROM w GROUP BY y, x")
def bilateral(spark, d):
    return _r(fo.bilateral_focal(emb_cube(spark, d).select("b1"), sigma_r=0.5))


@_add("running_sum", f"WITH {EV_SQL} SELECT t, y, x, {_s('CASE WHEN n IS NOT NULL THEN sum(n) OVER (PARTITION BY y, x ORDER BY t) END')} AS n FROM ev")
def running_sum(spark, d):
    return _r(scan.running(ev_cube(spark, d).select("n"), "sum"))


@_add("fill_ffill", f"WITH {EV_SQL} SELECT t, y, x, {_s('last_value(value IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS value FROM ev")
def fill_ffill(spark, d):
    return _r(scan.fill_gaps(ev_cube(spark, d).select("value"), "ffill"))


@_add("fill_bfill", f"WITH {EV_SQL} SELECT t, y, x, {_s('first_value(value IGNORE NULLS) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS value FROM ev")
def fill_bfill(spark, d):
    return _r(scan.fill_gaps(ev_cube(spark, d).select("value"), "bfill"))


@_add("fill_linear", f"""WITH {EV_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY t) AS i FROM ev), w AS (
  SELECT t, y, x, value, i, last_value(value IGNORE NULLS) OVER b AS f, first_value(value IGNORE NULLS) OVER a AS n,
         last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS fi, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni
  FROM i WINDOW b AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY y, x ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) SELECT t, y, x, {_s('coalesce(value, CASE WHEN ni > fi THEN (f * (ni - i) + n * (i - fi)) / (ni - fi) END, f, n)')} AS value FROM w""")
def fill_linear(spark, d):
    return _r(scan.fill_gaps(ev_cube(spark, d).select("value"), "linear"))


@_add("hampel", f"""WITH {EV_SQL}, w AS (
  SELECT t, y, x, value, list(value) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY y, x ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM ev
), m AS (SELECT *, list_median(w) AS med FROM w), s AS (SELECT *, 1.4826 * list_median(list_transform(w, lambda v: abs(v - med))) AS mad FROM m)
SELECT t, y, x, {_s('CASE WHEN value IS NULL THEN NULL WHEN abs(value - med) > 3 * mad THEN med ELSE value END')} AS value FROM s""")
def hampel(spark, d):
    return _r(scan.hampel_smooth(ev_cube(spark, d).select("value")))


@_add("ewma", f"""WITH {EV_SQL}, k AS (SELECT t, y, x, value, count(value) OVER w AS k FROM ev WINDOW w AS (PARTITION BY y, x ORDER BY t)),
s AS (SELECT t, y, x, k, sum(CASE WHEN k = 1 THEN value ELSE 0.3 * value END / pow(0.7, k)) OVER (PARTITION BY y, x ORDER BY t) AS s FROM k)
SELECT t, y, x, {_s('pow(0.7, k) * s')} AS value FROM s""")
def ewma(spark, d):
    return _r(scan.ewma(ev_cube(spark, d).select("value"), 0.3))


@_add("kalman")
def kalman(spark, d):
    return _r(scan.kalman_smooth(ev_cube(spark, d).select("value"), 5.0, 0.5, 20.0, robust_iters=1))


@_add("geomedian")
def geomedian(spark, d):
    return _r(multiband.geomedian(li_cube(spark, d).select("qty", "disc", "tax")))


@_add("medoid")
def medoid(spark, d):
    return _r(multiband.medoid(li_cube(spark, d).select("qty", "disc", "tax")))


@_add("band_project", f"WITH {EMB_SQL} SELECT y, x, {_s('0.5 * (b1 - 0.1) - 2 * b2 + 1.5 * (b3 - 0.2)')} AS v FROM emb")
def band_project(spark, d):
    return _r(multiband.band_project(emb_cube(spark, d), {"b1": 0.5, "b2": -2.0, "b3": 1.5}, {"b1": 0.1, "b3": 0.2}))


_W = [np.array([[1.0, -0.5], [0.25, 0.75]]), np.array([[1.0], [-2.0]])]


@_add("mlp_project", f"WITH {EMB_SQL}, h AS (SELECT y, x, greatest(b1 + 0.25 * b2 + 0.1, 0) AS p, greatest(-0.5 * b1 + 0.75 * b2 - 0.1, 0) AS q FROM emb) SELECT y, x, {_s('1 / (1 + exp(-(p - 2 * q + 0.05)))')} AS v FROM h")
def mlp_project(spark, d):
    return _r(multiband.mlp_project(emb_cube(spark, d).select("b1", "b2"), _W, [np.array([0.1, -0.1]), np.array([0.05])], output_activation="sigmoid"))


@_add("stack_bands", f"WITH {EMB_SQL} SELECT y, x, band, {_s('v')} AS v FROM (UNPIVOT (SELECT y, x, b1, b2 FROM emb) ON b1, b2 INTO NAME band VALUE v)")
def stack_bands(spark, d):
    return _r(select.stack_bands(emb_cube(spark, d).select("b1", "b2")))


@_add("stack_slices", f"WITH {EMB_SQL} SELECT t, y, x, {_s('v')} AS b1 FROM (SELECT 'a' AS t, y, x, b1 AS v FROM emb UNION ALL SELECT 'b', y, x, b1 * 2 FROM emb)")
def stack_slices(spark, d):
    c = emb_cube(spark, d).select("b1")
    return _r(select.lazy_stack({"a": c, "b": c * 2}, "t"))


def _coarse(g: GridSpec) -> GridSpec:
    """Cells of twice the size over the embeddings' grid, but its last column."""
    return GridSpec("EPSG:3857", (0.0, 20.0, 0.0, 10.0 * g.ny, 0.0, -20.0), (("x", 12), ("y", (g.ny + 1) // 2)), "f64")


def _shift(g: GridSpec) -> GridSpec:
    """The embeddings' grid moved by 3 to the right and 2 down, without the cells that would stick out."""
    return GridSpec("EPSG:3857", (3.0, 10.0, 0.0, 10.0 * g.ny - 2, 0.0, -10.0), (("x", 24), ("y", max(1, g.ny - 1))), "f64")


def _area(op: str, e: str) -> None:
    @_add(f"align_{op}", f"WITH {EMB_SQL} SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, {_s(e)} AS b1 FROM emb WHERE x < 24 GROUP BY 1, 2")
    def run(spark, d, op=op):
        c = emb_cube(spark, d).select("b1")
        return _r(warp.align(c, _coarse(c.grid), op))


for _op, _e in {"average": "avg(b1)", "sum": "sum(b1)", "min": "min(b1)", "max": "max(b1)", "med": "median(b1)", "q1": "quantile_cont(b1, 0.25)", "q3": "quantile_cont(b1, 0.75)", "rms": "sqrt(avg(b1 * b1))"}.items():
    _area(_op, _e)


_SHIFTED = "(SELECT y, c.range AS x FROM (SELECT unnest(range(greatest(1, (SELECT CAST(max(y) AS BIGINT) FROM emb)))) AS y), range(24) c) g"


@_add("align_near", f"WITH {EMB_SQL} SELECT CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x, {_s('b1')} AS b1 FROM {_SHIFTED} LEFT JOIN emb ON emb.y = floor((g.y * 10 + 7) / 10.0) AND emb.x = floor((g.x * 10 + 8) / 10.0)")
def align_near(spark, d):
    c = emb_cube(spark, d).select("b1")
    return _r(warp.align(c, _shift(c.grid), "near"))


@_add("align_bilinear", f"""WITH {EMB_SQL}, g AS (SELECT y, x, y + 0.7 AS r, x + 0.8 AS c FROM {_SHIFTED}),
w AS (SELECT g.y, g.x, emb.b1, (1 - abs(emb.y + 0.5 - g.r)) * (1 - abs(emb.x + 0.5 - g.c)) AS w FROM g JOIN emb ON abs(emb.y + 0.5 - g.r) < 1 AND abs(emb.x + 0.5 - g.c) < 1)
SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_s('sum(w * b1) / sum(w)')} AS b1 FROM w GROUP BY y, x""")
def align_bilinear(spark, d):
    c = emb_cube(spark, d).select("b1")
    return _r(warp.align(c, _shift(c.grid), "bilinear"))


#: Weight at a distance of {0} cells, and how many cells each way count.
_KERNELS = {
    "cubic": ("CASE WHEN {0} <= 1 THEN 1 + {0} * {0} * (1.5 * {0} - 2.5) WHEN {0} < 2 THEN 2 + {0} * (-4 + {0} * (2.5 - 0.5 * {0})) ELSE 0 END", 2),
    "cubicspline": ("CASE WHEN {0} <= 1 THEN 2 / 3.0 + {0} * {0} * ({0} / 2 - 1) WHEN {0} < 2 THEN (2 - {0}) * (2 - {0}) * (2 - {0}) / 6 ELSE 0 END", 2),
    "lanczos": ("CASE WHEN {0} < 1e-12 THEN 1 WHEN {0} < 3 THEN 3 * sin(pi() * {0}) * sin(pi() * {0} / 3) / (pi() * pi() * {0} * {0}) ELSE 0 END", 3),
}


def _kernel(op: str) -> None:
    e, reach = _KERNELS[op]

    @_add(f"align_{op}", f"""WITH {EMB_SQL}, g AS (SELECT y, x, CAST(y + 0.7 AS DOUBLE) AS r, CAST(x + 0.8 AS DOUBLE) AS c FROM {_SHIFTED}),
d AS (SELECT g.y, g.x, emb.b1, abs(emb.y + 0.5 - g.r) AS u, abs(emb.x + 0.5 - g.c) AS v FROM g JOIN emb ON abs(emb.y + 0.5 - g.r) < {reach} AND abs(emb.x + 0.5 - g.c) < {reach}),
w AS (SELECT y, x, b1, ({e.format('u')}) * ({e.format('v')}) AS w FROM d)
SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {_s('sum(w * b1) / sum(w)')} AS b1 FROM w GROUP BY y, x""")
    def run(spark, d, op=op):
        c = emb_cube(spark, d).select("b1")
        return _r(warp.align(c, _shift(c.grid), op))


for _op in _KERNELS:
    _kernel(_op)


@_add("align_mode", f"""WITH {EMB_SQL}, k AS (SELECT CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, CAST(b1 > 0 AS INTEGER) AS v, count(*) AS n FROM emb WHERE x < 24 GROUP BY 1, 2, 3)
SELECT y, x, {_s('v')} AS b1 FROM (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY n DESC, v) AS i FROM k) WHERE i = 1""")
def align_mode(spark, d):
    c = emb_cube(spark, d).select("b1")
    return _r(warp.align(c > 0, _coarse(c.grid), "mode"))


@_add("extract_points", f"WITH {EMB_SQL}, p AS (SELECT c_custkey AS id, c_custkey % 250 AS px, c_custkey * 7 % (SELECT 10 * (max(y) + 1) FROM emb) AS py FROM customer) SELECT id, {_s('b1')} AS b1, {_s('b2')} AS b2 FROM p LEFT JOIN emb ON emb.x = px // 10 AND emb.y = CAST(floor(((SELECT 10 * (max(y) + 1) FROM emb) - py) / 10.0) AS INTEGER)")
def extract_points(spark, d):
    c, e = spark.read.parquet(f"{d}/customer.parquet"), emb_cube(spark, d).select("b1", "b2")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 250).alias("x"), (F.col("c_custkey") * 7 % (10 * e.grid.ny)).alias("y"))
    return _r(warp.extract_points(e, p))


@_add("mosaic", "SELECT CAST(o_custkey % 30 AS INTEGER) AS y, CAST(o_custkey % 20 AS INTEGER) AS x, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderkey % 5 <> 0) AS v FROM orders GROUP BY 1, 2")
def mosaic_last(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = o.select((F.col("o_custkey") % 30).cast("int").alias("y"), (F.col("o_custkey") % 20).cast("int").alias("x"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("v"), "o_orderkey")
    return mosaic(t, ["y", "x"], ["v"], "o_orderkey")


@_add("dataset", f"""WITH {SRC_SQL}, r AS (
  SELECT substr(datetime, 1, 7) AS t, CAST(l_linenumber AS INTEGER) AS y, 0 AS x, asset, CASE WHEN l_quantity <> 25 THEN l_quantity * 0.1 - 1 END AS v, datetime, location
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) JOIN src ON location = '/data/' || l_orderkey || '.tif' WHERE asset IN ('1-URGENT', '2-HIGH')
), n AS (SELECT *, row_number() OVER (PARTITION BY t, y, x, asset ORDER BY datetime DESC, location DESC) AS i FROM r WHERE v IS NOT NULL)
SELECT k.t, k.y, k.x, {_s("max(CASE WHEN asset = '1-URGENT' THEN v END)")} AS "1-URGENT", {_s("max(CASE WHEN asset = '2-HIGH' THEN v END)")} AS "2-HIGH"
FROM (SELECT DISTINCT t, y, x FROM r) k LEFT JOIN n ON n.t = k.t AND n.y = k.y AND n.x = k.x AND n.i = 1 GROUP BY k.t, k.y, k.x""")
def dataset(spark, d):
    """Cells of overlapping tiles as a dataset of two assets by month: the last tile that has a value wins."""
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    cells = li.select(F.concat(F.lit("/data/"), F.col("l_orderkey").cast("string"), F.lit(".tif")).alias("location"), F.col("l_linenumber").cast("int").alias("y"), F.lit(0).alias("x"), F.col("l_quantity").alias("v"))
    assets = ["1-URGENT", "2-HIGH"]
    grid = GridSpec("EPSG:3857", (0.0, 10.0, 0.0, 80.0, 0.0, -10.0), (("x", 1), ("y", 8)), "f64")
    every = {a: 0.1 for a in assets}
    return _r(lazy_dataset(cells, stac.time_slices(src_table(spark, d), "month"), grid, assets, nodata={a: 25.0 for a in assets}, scale=every, offset={a: -1.0 for a in assets}, dense=False))


@_add("source_affine", f"WITH {LI_SQL} SELECT t, y, x, {_s('CASE WHEN qty <> 25 THEN qty * 0.1 - 1 END')} AS qty FROM li")
def source_affine(spark, d):
    c = li_cube(spark, d)
    return _r(lazy_source(c.df, c.grid, "qty", nodata=25, scale=0.1, offset=-1.0))


@_add("gradient")
def focal_gradient(spark, d):
    c = emb_cube(spark, d).select("b1", "b2")
    loss, grad = gradient.value_and_grad(c, np.full((3, 3), 1 / 9), gradient.squared_error, "b1", "b2")
    rows = [(-1, float(loss))] + [(i, float(v)) for i, v in enumerate(grad.ravel())]
    return _r(spark.createDataFrame(rows, "k int, v double"))


@_add("patch_model")
def patch_model(spark, d):
    k = np.linspace(-1, 1, 2 * 9).reshape(1, 2, 3, 3)
    from .functions.tensors import conv2d

    return _r(fo.lazy_patch(emb_cube(spark, d).select("b1", "b2"), lambda x: conv2d(x, k, padding=1), 1))


_SRC_COLS = "item_id, asset, location, datetime, cloud_cover, xmin, ymin, xmax, ymax"


@_add("stac_cloud", f"WITH {SRC_SQL} SELECT {_SRC_COLS} FROM src WHERE cloud_cover IS NULL OR cloud_cover < 40")
def stac_cloud(spark, d):
    return stac.filter_cloud(src_table(spark, d), 40)


@_add("stac_coverage", f"WITH {SRC_SQL} SELECT {_SRC_COLS} FROM src WHERE greatest(0, least(xmax, 30) - greatest(xmin, -20)) * greatest(0, least(ymax, -40) - greatest(ymin, -90)) / 2500 >= 0.04")
def stac_coverage(spark, d):
    return stac.filter_coverage(src_table(spark, d), (-20, -90, 30, -40), 0.04)


@_add("stac_assets", f"WITH {SRC_SQL} SELECT {_SRC_COLS} FROM src WHERE asset IN ('1-URGENT', '2-HIGH')")
def stac_assets(spark, d):
    return stac.filter_assets(src_table(spark, d), ["1-URGENT", "2-HIGH"])


@_add("stac_duplicates", f"WITH {SRC_SQL} SELECT {_SRC_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY xmin, ymin, xmax, ymax, datetime, asset ORDER BY item_id, location) AS n FROM src) WHERE n = 1")
def stac_duplicates(spark, d):
    return stac.drop_duplicates(src_table(spark, d))


@_add("stac_rename", f"WITH {SRC_SQL} SELECT item_id, CASE asset WHEN '1-URGENT' THEN 'red' ELSE 'nir' END AS asset, location, datetime, cloud_cover, xmin, ymin, xmax, ymax FROM src WHERE asset IN ('1-URGENT', '5-LOW')")
def stac_rename(spark, d):
    return stac.rename_assets(src_table(spark, d), {"1-URGENT": "red", "5-LOW": "nir"})


@_add("stac_merge", f"WITH {SRC_SQL} SELECT {_SRC_COLS} FROM src WHERE cloud_cover < 10 UNION ALL SELECT {_SRC_COLS} FROM src WHERE cloud_cover >= 90")
def stac_merge(spark, d):
    s = src_table(spark, d)
    return stac.merge(s.where("cloud_cover < 10"), s.where("cloud_cover >= 90"))


@_add("stac_slices", f"WITH {SRC_SQL} SELECT {_SRC_COLS}, substr(datetime, 1, 7) AS slice FROM src")
def stac_slices(spark, d):
    return stac.time_slices(src_table(spark, d), "month")


@_add("stac_solar_day", f"WITH {SRC_SQL} SELECT {_SRC_COLS}, strftime(CAST(replace(substr(datetime, 1, 19), 'T', ' ') AS TIMESTAMP) + INTERVAL 43200 SECOND, '%Y-%m-%d') AS slice FROM src")
def stac_solar_day(spark, d):
    return stac.time_slices(src_table(spark, d), "solar_day", lon=180.0)


@_add("periods", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS quarter FROM orders")
def periods(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    t = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", period(t, "week").alias("week"), period(t, "quarter").alias("quarter"))


@_add("quantized_sink", f"WITH {EMB_SQL} SELECT y, x, CAST(round_even(b1 * 1000, 0) AS SMALLINT) AS b1 FROM emb")
def quantized_sink(spark, d):
    return sinks.quantized(emb_cube(spark, d).select("b1"), "i16", scale=0.001, nodata=-32768).df
