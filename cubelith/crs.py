"""Map projections in closed form, on numbers, numpy arrays and Columns alike.

Known: EPSG:4326, EPSG:3857, UTM zones (EPSG:326xx, 327xx), and local ``laea``, ``aeqd``, ``eqdc`` and
``pconic`` projections written as ``+proj=... +lat_0=... +lon_0=...``.  An unknown system is refused.
The local ones are on the sphere of the WGS84 authalic radius.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import GridError

A, INV_F, AUTHALIC = 6378137.0, 298.257223563, 6371007.1809184747  # fixed values: WGS84


class _Np:
    sin, cos, tan, exp, log, sqrt, asin, atan, atan2, sinh, cosh = np.sin, np.cos, np.tan, np.exp, np.log, np.sqrt, np.arcsin, np.arctan, np.arctan2, np.sinh, np.cosh
    asinh, atanh = np.arcsinh, np.arctanh


class _Sql:
    sin, cos, tan, exp, log, sqrt, asin, atan, atan2, sinh, cosh = F.sin, F.cos, F.tan, F.exp, F.ln, F.sqrt, F.asin, F.atan, F.atan2, F.sinh, F.cosh
    asinh, atanh = F.asinh, F.atanh


def _m(x):
    return _Sql if isinstance(x, Column) else _Np


def normal(crs: str | int) -> str:
    """``EPSG:n`` or a proj string, blanks and case made alike."""
    s = str(crs).strip()
    if re.fullmatch(r"\d+", s):
        s = f"EPSG:{s}"
    return s.upper() if s.upper().startswith("EPSG:") else " ".join(sorted(s.split()))


def _utm(crs: str) -> tuple[float, float] | None:
    m = re.fullmatch(r"EPSG:32([67])(\d\d)", crs)
    if not m or not 1 <= int(m[2]) <= 60:
        return None
    return math.radians(int(m[2]) * 6 - 183), 1e7 if m[1] == "7" else 0.0


def _local(crs: str) -> dict[str, str]:
    return dict(p.lstrip("+").split("=", 1) for p in crs.split() if "=" in p)


def known(crs: str | int) -> bool:
    c = normal(crs)
    return c in ("EPSG:4326", "EPSG:3857") or _utm(c) is not None or _local(c).get("proj") in ("laea", "aeqd", "eqdc", "pconic")


def _krueger() -> tuple[float, list[float], list[float], float]:
    """Rectifying radius and series of the third flattening, to its fourth power."""
    n = 1 / (2 * INV_F - 1)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return radius, alpha, beta, n


def from_lonlat(crs: str | int, lon, lat):
    """Coordinates in ``crs`` of degrees."""
    c, m = normal(crs), _m(lon)
    if c == "EPSG:4326":
        return lon, lat
    lam, phi = lon * (math.pi / 180), lat * (math.pi / 180)
    if c == "EPSG:3857":
        return lam * A, m.asinh(m.tan(phi)) * A
    if utm := _utm(c):
        radius, alpha, _, n = _krueger()
        d = lam - utm[0]
        e = 2 * math.sqrt(n) / (1 + n)
        t = m.sinh(m.atanh(m.sin(phi)) - e * m.atanh(e * m.sin(phi)))
        xi, eta = m.atan2(t, m.cos(d)), m.asinh(m.sin(d) / m.sqrt(t * t + m.cos(d) * m.cos(d)))
        x, y = eta, xi
        for j, a in enumerate(alpha, 1):
            x = x + a * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
            y = y + a * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
        return 500000.0 + 0.9996 * radius * x, utm[1] + 0.9996 * radius * y
    p = _local(c)
    lat0, lon0 = math.radians(float(p.get("lat_0", 0))), math.radians(float(p.get("lon_0", 0)))
    d = lam - lon0
    kind = p.get("proj")
    if kind in ("laea", "aeqd"):
        cosc = math.sin(lat0) * m.sin(phi) + math.cos(lat0) * m.cos(phi) * m.cos(d)
        x, y = m.cos(phi) * m.sin(d), math.cos(lat0) * m.sin(phi) - math.sin(lat0) * m.cos(phi) * m.cos(d)
        if kind == "laea":
            k = m.sqrt(2 / (1 + cosc))
        else:
            s = m.sqrt(x * x + y * y)
            angle = m.atan2(s, cosc)
            k = F.when(s < 1e-15, F.lit(1.0)).otherwise(angle / s) if isinstance(s, Column) else np.where(s < 1e-15, 1.0, angle / np.maximum(s, 1e-300))
        return AUTHALIC * k * x, AUTHALIC * k * y
    if kind in ("eqdc", "pconic"):
        n, g, r0, mid, half = _conic(p, lat0, kind)
        r = (g - phi) if kind == "eqdc" else math.cos(half) * (1 / math.tan(mid) - m.tan(phi - mid))
        return AUTHALIC * r * m.sin(n * d), AUTHALIC * (r0 - r * m.cos(n * d))
    raise GridError(f"unknown coordinate system {crs!r}")


def _conic(p: dict[str, str], lat0: float, kind: str):
    a, b = math.radians(float(p.get("lat_1", 0))), math.radians(float(p.get("lat_2", p.get("lat_1", 0))))
    mid, half = (a + b) / 2, (b - a) / 2
    if kind == "eqdc":
        n = math.sin(a) if abs(a - b) < 1e-12 else (math.cos(a) - math.cos(b)) / (b - a)
        g = math.cos(a) / n + a
        return n, g, g - lat0, mid, half
    return math.sin(mid), 0.0, math.cos(half) * (1 / math.tan(mid) - math.tan(lat0 - mid)), mid, half


def to_lonlat(crs: str | int, x, y):
    """Degrees of coordinates in ``crs``."""
    c, m = normal(crs), _m(x)
    deg = 180 / math.pi
    if c == "EPSG:4326":
        return x, y
    if c == "EPSG:3857":
        return x / A * deg, m.atan(m.sinh(y / A)) * deg
    if utm := _utm(c):
        radius, _, beta, n = _krueger()
        xi, eta = (y - utm[1]) / (0.9996 * radius), (x - 500000.0) / (0.9996 * radius)
        u, v = xi, eta
        for j, b in enumerate(beta, 1):
            u = u - b * m.sin(2 * j * xi) * m.cosh(2 * j * eta)
            v = v - b * m.cos(2 * j * xi) * m.sinh(2 * j * eta)
        e = 2 * math.sqrt(n) / (1 + n)
        want = m.asinh(m.sin(u) / m.sqrt(m.sinh(v) * m.sinh(v) + m.cos(u) * m.cos(u)))
        q = want
        for _ in range(5):  # isometric to geographic latitude
            q = want + e * m.atanh(e * (m.sinh(q) / m.cosh(q)))
        return (utm[0] + m.atan2(m.sinh(v), m.cos(u))) * deg, m.atan(m.sinh(q)) * deg
    p = _local(c)
    lat0, lon0 = math.radians(float(p.get("lat_0", 0))), math.radians(float(p.get("lon_0", 0)))
    x, y, kind = x / AUTHALIC, y / AUTHALIC, p.get("proj")
    if kind in ("laea", "aeqd"):
        r = m.sqrt(x * x + y * y)
        angle = 2 * m.asin(r / 2) if kind == "laea" else r
        sin, cos = m.sin(angle), m.cos(angle)
        if isinstance(r, Column):
            lat = F.when(r < 1e-15, F.lit(lat0)).otherwise(F.asin(cos * math.sin(lat0) + y * sin * math.cos(lat0) / r))
        else:
            lat = np.where(r < 1e-15, lat0, np.arcsin(np.clip(cos * math.sin(lat0) + y * sin * math.cos(lat0) / np.maximum(r, 1e-300), -1, 1)))
        return (lon0 + m.atan2(x * sin, r * math.cos(lat0) * cos - y * math.sin(lat0) * sin)) * deg, lat * deg
    if kind in ("eqdc", "pconic"):
        n, g, r0, mid, half = _conic(p, lat0, kind)
        sign = 1.0 if n > 0 else -1.0
        r, angle = sign * m.sqrt(x * x + (r0 - y) * (r0 - y)), m.atan2(sign * x, sign * (r0 - y))
        lat = (g - r) if kind == "eqdc" else mid + m.atan(1 / math.tan(mid) - r / math.cos(half))
        return (lon0 + angle / n) * deg, lat * deg
    raise GridError(f"unknown coordinate system {crs!r}")


def transform(source: str, target: str, x, y):
    if normal(source) == normal(target):
        return x, y
    return from_lonlat(target, *to_lonlat(source, x, y))
