"""Drawings of a cube's steps, its plan, and previews."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import numpy as np
from pyspark.sql import functions as F

from ..cube import Cube
from . import options


def draw(cube: Cube) -> str:
    """The cube in words: grid, bands and steps."""
    g = cube.grid
    lines = [f"{g.nx} x {g.ny} cells, {g.crs}, {g.dtype}", f"axes {', '.join(cube.axes) or 'none'}; bands {', '.join(cube.bands)}" + (f"; mask {cube.mask_asset}" if cube.mask_asset else "")]
    return "\n".join(lines + [f"  {i + 1}. {s}" for i, s in enumerate(cube.steps)])


def plan_dot(cube: Cube) -> str:
    """The steps as a DOT graph."""
    nodes = [f'  n{i} [label="{s}"];' for i, s in enumerate(cube.steps)]
    edges = [f"  n{i} -> n{i + 1};" for i in range(len(cube.steps) - 1)]
    return "\n".join(["digraph plan {", "  rankdir=LR;", *nodes, *edges, "}"])


def plan_text(cube: Cube, mode: str = "formatted") -> str:
    """Spark's physical plan."""
    out = io.StringIO()
    with redirect_stdout(out):
        cube.df.explain(mode)
    return out.getvalue()


def preview(cube: Cube, size: int | None = None, low: float = 0.02, high: float = 0.98) -> dict:
    """Every n-th cell of each band, stretched between percentiles; at most 11 different values count as classes.

    The stride is a filter on the cells, so what is not shown is not computed for elementwise cubes.
    """
    step = max(1, -(-max(cube.grid.nx, cube.grid.ny) // (size or options.get(cube.df.sparkSession, "previewSize"))))
    some = cube.df.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    stats = some.agg(*[F.percentile_approx(F.col(b).cast("double"), [low, high]).alias(f"p_{b}") for b in cube.bands], *[F.approx_count_distinct(b).alias(f"n_{b}") for b in cube.bands]).first()
    rows = some.select("y", "x", *[F.col(b).cast("double").alias(b) for b in cube.bands]).toPandas()
    out = {}
    for b in cube.bands:
        a = np.full((-(-cube.grid.ny // step), -(-cube.grid.nx // step)), np.nan)
        a[rows["y"].to_numpy() // step, rows["x"].to_numpy() // step] = rows[b].to_numpy(float)
        lo, hi = stats[f"p_{b}"] or (0.0, 1.0)
        kind = "classes" if stats[f"n_{b}"] <= 11 else "range"
        out[b] = {"kind": kind, "range": (lo, hi), "values": a if kind == "classes" else np.clip((a - lo) / ((hi - lo) or 1), 0, 1)}
    return out


def task_report(path: str) -> list[dict]:
    """Stages of a Spark event log: tasks, seconds and shuffled bytes."""
    import json

    stages: dict[int, dict] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            e = json.loads(line)
            if e.get("Event") == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                s = stages.setdefault(e["Stage ID"], {"stage": e["Stage ID"], "tasks": 0, "seconds": 0.0, "shuffled": 0})
                s["tasks"] += 1
                s["seconds"] += m.get("Executor Run Time", 0) / 1000
                s["shuffled"] += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
    return sorted(stages.values(), key=lambda s: -s["seconds"])
