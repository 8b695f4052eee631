"""Grids: where cells are.  A grid is driver-side metadata beside a DataFrame, never a column."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from . import crs as _crs
from . import dtypes
from .errors import GridError


@dataclass(frozen=True)
class GridSpec:
    """Coordinate system, affine transform, extent, named dimensions (x, y first), type and labels.

    ``transform`` is (x of the left edge, cell width, 0, y of the top edge, 0, minus cell height).
    """

    crs: str
    transform: tuple[float, float, float, float, float, float]
    dims: tuple[tuple[str, int], ...]
    dtype: str = "f32"
    labels: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "crs", _crs.normal(self.crs))
        object.__setattr__(self, "transform", tuple(map(float, self.transform)))
        object.__setattr__(self, "dims", tuple((str(k), int(n)) for k, n in self.dims))
        object.__setattr__(self, "labels", {k: tuple(v) for k, v in self.labels.items()})
        names = [k for k, _ in self.dims]
        if not 2 <= len(names) <= 4 or names[:2] != ["x", "y"] or set(names[2:]) - {"t", "band"} or len(set(names)) < len(names):
            raise GridError(f"dims must be x, y and at most t and band: {names}")
        if any(n < 1 for _, n in self.dims):
            raise GridError("dims must be positive")
        if not dtypes.valid(self.dtype):
            raise GridError(f"unknown dtype {self.dtype!r}")
        _, w, r1, _, r2, h = self.transform
        if r1 or r2:
            raise GridError("rotated grids are not supported")
        if not w > 0 or not h < 0:
            raise GridError("grids must be north-up")
        for k, v in self.labels.items():
            if k not in names[2:] or len(v) != dict(self.dims)[k]:
                raise GridError(f"labels of {k!r} do not fit its length")

    @property
    def shape(self) -> dict[str, int]:
        return dict(self.dims)

    @property
    def nx(self) -> int:
        return self.dims[0][1]

    @property
    def ny(self) -> int:
        return self.dims[1][1]

    @property
    def extent(self) -> tuple[float, float, float, float]:
        x0, w, _, y0, _, h = self.transform
        return x0, y0 + h * self.ny, x0 + w * self.nx, y0

    def spatial(self) -> GridSpec:
        return replace(self, dims=self.dims[:2], labels={})

    def without(self, *dims: str) -> GridSpec:
        """After reducing: t and band go, x and y shrink to one cell over the same extent."""
        out, kept = self, tuple(d for d in self.dims if d[0] in ("x", "y") or d[0] not in dims)
        x0, w, _, y0, _, h = self.transform
        if "x" in dims:
            kept, w = (("x", 1), *kept[1:]), w * self.nx
        if "y" in dims:
            kept, h = (kept[0], ("y", 1), *kept[2:]), h * self.ny
        return replace(out, transform=(x0, w, 0, y0, 0, h), dims=kept, labels={k: v for k, v in self.labels.items() if k in dict(kept)})

    def stacked(self, along: str, labels: list[str] | int) -> GridSpec:
        if along in self.shape:
            raise GridError(f"the grid has a dimension {along!r} already")
        n = labels if isinstance(labels, int) else len(labels)
        more = {} if isinstance(labels, int) or not all(labels) else {along: tuple(labels)}
        return replace(self, dims=(*self.dims, (along, n)), labels={**self.labels, **more})


def grid_spec(crs: str | int, extent: tuple[float, float, float, float], dims: tuple[int, int] | None = None, res: float | tuple[float, float] | None = None, dtype: str = "f32") -> GridSpec:
    """From an extent (xmin, ymin, xmax, ymax) and exactly one of dims (nx, ny) and res, which snaps from the top left."""
    x0, y0, x1, y1 = map(float, extent)
    if not (x1 > x0 and y1 > y0):
        raise GridError("the extent is empty")
    if (dims is None) == (res is None):
        raise GridError("give one of dims and res")
    if dims is not None:
        nx, ny = dims
        w, h = (x1 - x0) / nx, (y1 - y0) / ny
    else:
        w, h = (res, res) if isinstance(res, (int, float)) else res
        nx, ny = (max(1, math.ceil(v - 1e-9)) for v in ((x1 - x0) / w, (y1 - y0) / h))
    return GridSpec(str(crs), (x0, w, 0, y1, 0, -h), (("x", nx), ("y", ny)), dtype)


def xmin(g: GridSpec) -> float:
    return g.extent[0]


def ymin(g: GridSpec) -> float:
    return g.extent[1]


def xmax(g: GridSpec) -> float:
    return g.extent[2]


def ymax(g: GridSpec) -> float:
    return g.extent[3]


def res(g: GridSpec) -> tuple[float, float]:
    return g.transform[1], -g.transform[5]


def center_out_extent(g: GridSpec) -> tuple[float, float, float, float]:
    """The extent as (xmin, xmax, ymin, ymax)."""
    x0, y0, x1, y1 = g.extent
    return x0, x1, y0, y1


def crs_equal(a: str | int, b: str | int) -> bool:
    return _crs.normal(a) == _crs.normal(b)


def grid_diff(a: GridSpec, b: GridSpec, tol: float = 1e-9) -> str | None:
    """The first component that differs, in words; None if none does.  Labels do not count."""
    if not crs_equal(a.crs, b.crs):
        return f"crs: {a.crs} and {b.crs}"
    for k, (p, q) in enumerate(zip(a.transform, b.transform, strict=True)):
        if abs(p - q) > tol * max(1.0, abs(p), abs(q)):
            return f"transform[{k}]: {p:g} and {q:g}"
    if a.dims != b.dims:
        return f"dims: {a.shape} and {b.shape}"
    if a.dtype != b.dtype:
        return f"dtype: {a.dtype} and {b.dtype}"
    return None


def grid_equal(a: GridSpec, b: GridSpec, tol: float = 1e-9) -> bool:
    return grid_diff(a, replace(b, dtype=a.dtype), tol) is None


def spatial_equal(a: GridSpec, b: GridSpec) -> bool:
    return grid_equal(a.spatial(), b.spatial())


def grid_from_bbox(bbox: tuple[float, float, float, float], res: float, projection: str = "laea", buffer: float = 0.0, dtype: str = "f32") -> GridSpec:
    """A grid in a projection centred on a box of degrees, covering it."""
    lon0, lat0 = (bbox[0] + bbox[2]) / 2, (bbox[1] + bbox[3]) / 2
    if projection == "utm":
        crs = f"EPSG:32{'7' if lat0 < 0 else '6'}{int((lon0 + 180) // 6) % 60 + 1:02d}"
    elif projection in ("laea", "aeqd"):
        crs = f"+proj={projection} +lat_0={lat0:g} +lon_0={lon0:g}"
    elif projection in ("eqdc", "pconic"):
        sixth = (bbox[3] - bbox[1]) / 6
        crs = f"+proj={projection} +lat_0={lat0:g} +lon_0={lon0:g} +lat_1={bbox[1] + sixth:g} +lat_2={bbox[3] - sixth:g}"
    else:
        raise GridError(f"unknown projection {projection!r}")
    x0, y0, x1, y1 = project_extent(bbox, "EPSG:4326", crs)
    x0, y0, x1, y1 = x0 - buffer, y0 - buffer, x1 + buffer, y1 + buffer
    snapped = (math.floor(x0 / res) * res, math.floor(y0 / res) * res, math.ceil(x1 / res) * res, math.ceil(y1 / res) * res)
    return grid_spec(crs, snapped, res=res, dtype=dtype)


def grid_from_src(source: GridSpec, res: float | None = None, buffer: float = 0.0, dtype: str | None = None) -> GridSpec:
    """A grid over another's extent, in its system."""
    x0, y0, x1, y1 = source.extent
    return grid_spec(source.crs, (x0 - buffer, y0 - buffer, x1 + buffer, y1 + buffer), res=res or source.transform[1], dtype=dtype or source.dtype)


def project_extent(extent: tuple[float, float, float, float], source: str, target: str, steps: int = 33) -> tuple[float, float, float, float]:
    """Extent in another system, from points along all edges and inside."""
    x, y = np.meshgrid(np.linspace(extent[0], extent[2], steps), np.linspace(extent[1], extent[3], steps))
    u, v = _crs.transform(source, target, x.ravel(), y.ravel())
    return float(np.min(u)), float(np.min(v)), float(np.max(u)), float(np.max(v))


@dataclass(frozen=True)
class Window:
    """A rectangle of cells."""

    y0: int
    x0: int
    ny: int
    nx: int


def chunks(g: GridSpec, size: int = 256) -> Iterator[Window]:
    """Tiles of a grid, by rows."""
    for y in range(0, g.ny, size):
        for x in range(0, g.nx, size):
            yield Window(y, x, min(size, g.ny - y), min(size, g.nx - x))


def with_halo(w: Window, g: GridSpec, radius: int) -> tuple[Window, tuple[int, int, int, int]]:
    """The window grown by a radius and cut at the grid, and the cells cut away (top, left, bottom, right)."""
    y0, x0, y1, x1 = w.y0 - radius, w.x0 - radius, w.y0 + w.ny + radius, w.x0 + w.nx + radius
    cy0, cx0, cy1, cx1 = max(0, y0), max(0, x0), min(g.ny, y1), min(g.nx, x1)
    return Window(cy0, cx0, cy1 - cy0, cx1 - cx0), (cy0 - y0, cx0 - x0, y1 - cy1, x1 - cx1)


def snap_to_blocks(size: int, block: int) -> int:
    """The largest multiple of a file's block up to a chunk size, one block at least."""
    return max(block, size // block * block)


def cross_grid_window(target: GridSpec, w: Window, source: GridSpec, margin: int = 2) -> Window | None:
    """Source cells that can matter for a window of a target grid; contains them all."""
    x0, cw, _, y0, _, ch = target.transform
    box = (x0 + w.x0 * cw, y0 + (w.y0 + w.ny) * ch, x0 + (w.x0 + w.nx) * cw, y0 + w.y0 * ch)
    same = crs_equal(target.crs, source.crs)
    u0, v0, u1, v1 = box if same else project_extent(box, target.crs, source.crs)
    sx, sw, _, sy, _, sh = source.transform
    m = 0 if same else margin
    c0, c1 = math.floor((u0 - sx) / sw + 1e-9) - m, math.ceil((u1 - sx) / sw - 1e-9) + m
    r0, r1 = math.floor((v1 - sy) / sh + 1e-9) - m, math.ceil((v0 - sy) / sh - 1e-9) + m
    c0, r0, c1, r1 = max(0, c0), max(0, r0), min(source.nx, c1), min(source.ny, r1)
    return Window(r0, c0, r1 - r0, c1 - c0) if c1 > c0 and r1 > r0 else None
