"""Reductions over t, band, and x with y, and calendar groups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dtypes
from ..cube import Cube, slices_of
from ..errors import PlanError, ReduceUnsupported
from ..functions.nodata import INF

#: Reductions by name.
NAMES = ("sum", "mean", "min", "max", "count", "median", "prod", "quantile", "sd", "var", "any", "all")


def aggregate(op: str, c: Column, nan_rm: bool = True, q: float = 0.5, cells: Column | None = None) -> Column:
    """One reduction of a column's rows, which stand for ``cells`` cells (as many as there are rows, if None).

    With ``nan_rm`` missing cells are left out, and a cell without any value is 0 for sum and count, 1 for prod, plus or minus
    infinity for min and max, missing for the others.  Without it, one missing cell makes the result missing; count never minds.
    """
    x = c.cast("double")
    on = {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "mean": lambda: F.avg(x),
        "min": lambda: F.coalesce(F.min(x), F.lit(INF)),
        "max": lambda: F.coalesce(F.max(x), F.lit(-INF)),
        "count": lambda: F.count(c),
        "median": lambda: F.median(x),
        "prod": lambda: F.coalesce(F.product(x), F.lit(1.0)),
        "quantile": lambda: F.percentile(x, q),
        "sd": lambda: F.stddev_samp(x),
        "var": lambda: F.var_samp(x),
        "any": lambda: F.coalesce(F.bool_or(x != 0), F.lit(False)),
        "all": lambda: F.coalesce(F.bool_and(x != 0), F.lit(True)),
    }
    if op not in on:
        raise ReduceUnsupported(f"unknown reduction {op!r}")
    out = on[op]()
    return out if nan_rm or op == "count" else F.when(F.count(c) == (F.count(F.lit(1)) if cells is None else cells), out)


def across(op: str, values: list[Column], nan_rm: bool = True, q: float = 0.5) -> Column:
    """The same over columns of one row."""
    xs = F.array(*[v.cast("double") for v in values])
    own = F.filter(xs, lambda v: v.isNotNull())
    n = F.size(own)
    total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
    mean = F.when(n > 0, total / n)

    def at(place: Column) -> Column:
        s, lo = F.array_sort(own), F.floor(place)
        a, b = F.try_element_at(s, (lo + 1).cast("int")), F.try_element_at(s, (F.least(lo + 1, n - 1) + 1).cast("int"))
        return F.when(n > 0, a + (b - a) * (place - lo))

    var = F.when(n > 1, F.aggregate(own, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / (n - 1))
    on = {
        "sum": total,
        "mean": mean,
        "min": F.coalesce(F.array_min(own), F.lit(INF)),
        "max": F.coalesce(F.array_max(own), F.lit(-INF)),
        "count": n.cast("long"),
        "median": at((n - 1) * 0.5),
        "prod": F.aggregate(own, F.lit(1.0), lambda a, v: a * v),
        "quantile": at((n - 1) * q),
        "sd": F.sqrt(var),
        "var": var,
        "any": F.exists(own, lambda v: v != 0),
        "all": F.forall(own, lambda v: v != 0),
    }
    if op not in on:
        raise ReduceUnsupported(f"unknown reduction {op!r}")
    return on[op] if nan_rm or op == "count" else F.when(n == len(values), on[op])


def reduce_over(cube: Cube, op: str | Callable[[Column], Column], over: str | tuple[str, ...] = "t", nan_rm: bool = True, q: float = 0.5, bands: tuple[str, ...] | None = None, strict: bool = True) -> Cube:
    """Reduces axes: ``t``, ``band``, ``x`` and ``y`` (together).

    ``op``: a name, or a function of an array Column (the cell's values in order of t, missing ones included).
    Over x and y, functions and order statistics would bring a whole raster to one task and are refused, unless ``strict`` is false.
    Without ``nan_rm`` an absent row is a missing cell too.
    """
    over = (over,) if isinstance(over, str) else tuple(over)
    if wrong := [a for a in over if a not in ("t", "band", "x", "y")]:
        raise ReduceUnsupported(f"unknown axes {wrong}")
    if ("x" in over) != ("y" in over):
        raise ReduceUnsupported("x and y are reduced together")
    if strict and "x" in over and (callable(op) or op in ("median", "quantile")):
        raise ReduceUnsupported(f"{op} does not combine over x and y")
    own = tuple(b for b in (cube.value_bands if bands is None else bands) if b in cube.bands)
    dtype = cube.grid.dtype if callable(op) else dtypes.of_reduction(op, cube.grid.dtype)
    step = f"{op if isinstance(op, str) else 'reduce'} over {', '.join(over)}"
    rows = [a for a in over if a != "band"]
    if wrong := [a for a in rows if a not in cube.axes]:
        raise PlanError(f"the cube has no axis {wrong}")
    df, axes, grid = cube.df, cube.axes, cube.grid
    kind = dtypes.spark_type(dtype)
    if "band" in over and not rows:
        value = across(op, [F.col(b) for b in own], nan_rm, q) if isinstance(op, str) else op(F.array(*own))
        return cube.having(step, df=df.select(*axes, value.cast(kind).alias(own[0] if len(own) == 1 else "v")), bands=("v",) if len(own) > 1 else own, mask_asset=None, grid=replace(grid, dtype=dtype))
    width = len(own)
    if "band" in over:  # bands as rows, then one reduction over all
        pairs = F.explode(F.array(*own)).alias("v")
        df, own = df.select(*axes, pairs), ("v",)
    left = [a for a in axes if a not in rows]
    if callable(op):
        order = [a for a in ("t", "y", "x") if a in rows and a in axes]
        value = lambda b: op(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(b).alias("_v")))), lambda s: s["_v"]))
    else:
        cells = None
        if not nan_rm and op != "count":
            n = (grid.ny * grid.nx if "x" in rows else 1) * (width if "band" in over else 1)
            cells = F.lit(n)
            if "t" in rows and not cube.dense:
                df = df.crossJoin(F.broadcast(slices_of(cube).agg(F.count(F.lit(1)).alias("_slices"))))  # one row
                cells = F.max("_slices") * n
            elif "t" in rows:
                cells = F.count_distinct("t") * n
        value = lambda b: aggregate(op, F.col(b), nan_rm, q, cells)
    out = [value(b).cast(kind).alias(b) for b in own]
    made = df.groupBy(*left).agg(*out) if left else df.agg(*out)
    return cube.having(step, df=made.select(*left, *own), bands=own, axes=tuple(left), mask_asset=None, grid=replace(grid.without(*rows), dtype=dtype))


def label_date(t: Column) -> Column:
    """Date of a slice label: a day, a month, or an exact time."""
    day = F.when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(F.substring(t, 1, 10))
    return F.to_date(day)


def period(t: Column, by: str | Callable[[Column], Column]) -> Column:
    """Calendar label of a slice label."""
    if callable(by):
        return by(t)
    d = label_date(t)
    labels = {
        "year": lambda: F.date_format(d, "yyyy"),
        "quarter": lambda: F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string")),
        "month": lambda: F.date_format(d, "yyyy-MM"),
        "week": lambda: F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0")),
        "day": lambda: F.date_format(d, "yyyy-MM-dd"),
    }
    if by not in labels:
        raise PlanError(f"unknown period {by!r}")
    return labels[by]()


class Groups:
    """A cube's slices by calendar period; one plan for all periods."""

    def __init__(self, cube: Cube, by):
        self.cube, self.by = cube, by

    def reduce_over(self, op, over: str = "t", nan_rm: bool = True, q: float = 0.5) -> Cube:
        """A cube whose slices are the periods."""
        if over != "t":
            raise ReduceUnsupported("groups are reduced over t")
        c = self.cube
        marked = c.df.select(period(F.col("t"), self.by).alias("t"), F.col("t").alias("_t"), "y", "x", *c.value_bands)
        kind = dtypes.spark_type(c.grid.dtype if callable(op) else dtypes.of_reduction(op, c.grid.dtype))
        if callable(op):
            value = lambda b: op(F.transform(F.array_sort(F.collect_list(F.struct("_t", F.col(b).alias("_v")))), lambda s: s["_v"]))
        else:
            value = lambda b: aggregate(op, F.col(b), nan_rm, q)
        df = marked.groupBy("t", "y", "x").agg(*[value(b).cast(kind).alias(b) for b in c.value_bands])
        grid = replace(c.grid.without("t"), dtype=c.grid.dtype if callable(op) else dtypes.of_reduction(op, c.grid.dtype))
        return Cube(df, grid, c.value_bands, ("t", "y", "x"), None, (*c.steps, f"{op} by {self.by}"))


def group_by_time(cube: Cube, by: str | Callable[[Column], Column] = "month") -> Groups:
    return Groups(cube, by)
