"""Quality masks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube
from ..errors import PlanError
from ..functions.cells import in_values
from .focal import dilate, morph_open


def mask(cube: Cube, from_: str | Cube | None = None, where: Callable[[Column], Column] | list | set | tuple = (), open_: int = 0, dilate_: int = 0, drop: bool = True, join: str = "exact") -> Cube:
    """Missing wherever the mask band says so.

    ``where``: the values to mask, or a predicate of the band's column (``qa_bits``).  The mask can be opened and then grown
    by disks; a mask value that is missing reads as clear.  ``from_``: a band of the cube (its mask band), or
    another cube's only band, whose slices must cover the cube's (``exact``) or are met where both have them (``inner``).
    """
    pred = where if callable(where) else in_values(where)
    if isinstance(from_, Cube):
        source, name = from_, from_.bands[0]
    else:
        name = from_ or cube.mask_asset
        if name is None:
            raise PlanError("the cube has no mask band")
        source = cube.select(name)
    marked = replace(source, df=source.df.select(*source.axes, pred(F.col(name)).cast("double").alias("_m")), bands=("_m",), mask_asset=None)
    if open_ or dilate_:
        marked = dilate(morph_open(marked, "_m", open_), "_m", dilate_)
    hit = F.coalesce(F.col("_m") > 0.5, F.lit(False))
    keep = [b for b in cube.bands if not (drop and b == name and not isinstance(from_, Cube))]
    values = [F.when(hit, None).otherwise(F.col(b)).alias(b) if b != name or isinstance(from_, Cube) else F.col(b) for b in keep]
    if not (open_ or dilate_ or isinstance(from_, Cube)):  # the mask is a column of the same rows
        df = cube.df.select("*", pred(F.col(name)).cast("double").alias("_m"))
    else:
        if isinstance(from_, Cube) and join == "exact" and "t" in source.axes:
            lacking = cube.df.select("t").distinct().join(source.df.select("t").distinct(), "t", "left_anti").limit(1).collect()
            if lacking:
                raise PlanError(f"the mask has no slice {lacking[0].t!r}")
        on = [a for a in cube.axes if a in source.axes]
        df = cube.df.join(marked.df, on, "left")
        if join == "inner" and "t" in source.axes:
            df = df.join(source.df.select("t").distinct(), "t", "left_semi")
    return cube.having(f"mask by {name}", df=df.select(*cube.axes, *values), bands=tuple(keep), mask_asset=cube.mask_asset if cube.mask_asset in keep else None)
