"""Weights in the safetensors format (F32 only)."""

from __future__ import annotations

import json
import struct
from pathlib import Path

import numpy as np


def _header(path: str | Path) -> tuple[dict, int]:
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        return json.loads(f.read(n)), 8 + n


def ls(path: str | Path) -> dict[str, tuple[int, ...]]:
    """Shape by name."""
    return {k: tuple(v["shape"]) for k, v in _header(path)[0].items() if k != "__metadata__"}


def read(path: str | Path, names: list[str] | None = None) -> dict[str, np.ndarray]:
    head, base = _header(path)
    out = {}
    with open(path, "rb") as f:
        for k in names or [k for k in head if k != "__metadata__"]:
            if head[k]["dtype"] != "F32":
                raise ValueError(f"{k}: only F32 is read")
            lo, hi = head[k]["data_offsets"]
            f.seek(base + lo)
            out[k] = np.frombuffer(f.read(hi - lo), "<f4").reshape(head[k]["shape"])
    return out


def write(path: str | Path, tensors: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for k, v in tensors.items():
        n = int(np.prod(v.shape)) * 4
        head[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + n]}
        at += n
    raw = json.dumps(head).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(raw)) + raw)
        for v in tensors.values():
            f.write(np.ascontiguousarray(v, "<f4").tobytes())
