"""Gradients of a masked mean loss over a linear neighbourhood model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cube import Cube
from ..errors import GradUnsupported
from .focal import gather, window


def value_and_grad(cube: Cube, weights: np.ndarray, target: Callable[[Column, Column], tuple[Column, Column]], band: str, target_band: str, reduction: str = "mean") -> tuple[float, np.ndarray]:
    """Loss and its gradient with respect to a focal kernel's weights, in one aggregation.

    ``target(out, truth)`` gives a cell's loss and its derivative by ``out``.  Cells with a missing neighbour or truth do not
    count.  With the kernel's output linear in the weights, the derivative by weight k is the sum of the cell's derivative
    times its k-th neighbour.
    """
    if reduction not in ("sum", "mean"):
        raise GradUnsupported(f"unknown reduction {reduction!r}")
    w = np.asarray(weights, float)
    offsets, n = window(w.shape[0] // 2), w.size
    centre = offsets.index((0, 0))
    value = lambda b, place: F.transform(F.array_sort(F.collect_list(F.when(F.col(b).isNotNull(), F.struct(place.alias("p"), F.col(b).cast("double").alias("v"))))), lambda e: e["v"])
    near = gather(cube, offsets, value, (band,), [F.max(F.when(F.col("place") == centre, F.col(target_band).cast("double"))).alias("_y")]) if target_band == band else None
    if near is None:
        truth = cube.df.select(*cube.axes, F.col(target_band).cast("double").alias("_y"))
        near = gather(cube, offsets, value, (band,)).join(truth, list(cube.axes))
    whole = near.where((F.size(band) == n) & F.col("_y").isNotNull())
    out = F.aggregate(F.zip_with(F.col(band), F.array(*[F.lit(float(v)) for v in w.ravel()]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    loss, slope = target(F.col("_out"), F.col("_y"))
    rows = whole.withColumn("_out", out).select(loss.alias("_loss"), slope.alias("_slope"), band)
    got = rows.agg(F.count(F.lit(1)), F.sum("_loss"), *[F.sum(F.col("_slope") * F.col(band)[i]) for i in range(n)]).first()
    if not got[0]:
        raise GradUnsupported("no cell has all its neighbours")
    size = got[0] if reduction == "mean" else 1
    return got[1] / size, np.array(got[2:], float).reshape(w.shape) / size


def squared_error(out: Column, truth: Column) -> tuple[Column, Column]:
    return (out - truth) * (out - truth), 2 * (out - truth)
