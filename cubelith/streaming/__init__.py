"""Composites of streams of cells, an extension: the batch operators on event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reduce import aggregate


def windowed_composite(cells: DataFrame, bands: list[str], op: str = "mean", every: str = "1 day", late: str = "1 day", ts: str = "ts") -> DataFrame:
    """``window, y, x`` and each band reduced, of a stream (or table) of ``ts, y, x, bands``; cells later than ``late`` are left out."""
    return cells.withWatermark(ts, late).groupBy(F.window(ts, every), "y", "x").agg(*[aggregate(op, F.col(b)).alias(b) for b in bands])
