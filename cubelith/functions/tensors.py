"""Array operations on numpy planes, for tile functions: ``[y, x]`` or ``[channel, y, x]``."""

from __future__ import annotations

import numpy as np
import pandas as pd


def pad(x: np.ndarray, h: int, value: float = np.nan) -> np.ndarray:
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + [(h, h), (h, h)], constant_values=value)


def pad_right_bottom(x: np.ndarray, multiple: int, value: float = 0.0) -> np.ndarray:
    """Padded at the right and bottom to a multiple."""
    more = [(0, -n % multiple) for n in x.shape[-2:]]
    return np.pad(x, [(0, 0)] * (x.ndim - 2) + more, constant_values=value)


def shifts(x: np.ndarray, radius: int) -> list[np.ndarray]:
    """The ``(2r+1)**2`` shifted planes by rows of (dy, dx); missing outside."""
    p, (ny, nx) = pad(x, radius), x.shape[-2:]
    n = 2 * radius + 1
    return [p[..., dy : dy + ny, dx : dx + nx] for dy in range(n) for dx in range(n)]


def conv2d(x: np.ndarray, w: np.ndarray, bias: np.ndarray | None = None, stride: int = 1, padding: int = 0, dilation: int = 1, groups: int = 1) -> np.ndarray:
    """Cross-correlation of ``[c, y, x]`` with ``[out, c / groups, ky, kx]``, zeros outside."""
    x = np.pad(x, ((0, 0), (padding, padding), (padding, padding)))
    out_n, in_n, ky, kx = w.shape
    wide_y, wide_x = dilation * (ky - 1) + 1, dilation * (kx - 1) + 1
    v = np.lib.stride_tricks.sliding_window_view(x, (wide_y, wide_x), axis=(1, 2))[:, ::stride, ::stride, ::dilation, ::dilation]
    per = out_n // groups
    out = np.concatenate([np.einsum("cyxij,ocij->oyx", v[g * in_n : (g + 1) * in_n], w[g * per : (g + 1) * per], optimize=True) for g in range(groups)])
    return out if bias is None else out + bias[:, None, None]


def upsample2x(x: np.ndarray) -> np.ndarray:
    """Each cell twice in both directions."""
    return x.repeat(2, axis=-2).repeat(2, axis=-1)


def transpose(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return np.transpose(x, axes)


def squeeze(x: np.ndarray, axis: int) -> np.ndarray:
    return np.squeeze(x, axis)


def expand(x: np.ndarray, axis: int, n: int) -> np.ndarray:
    return np.repeat(np.expand_dims(x, axis), n, axis)


def broadcast(*xs: np.ndarray) -> list[np.ndarray]:
    return list(np.broadcast_arrays(*xs))


def first_argmax(logits: np.ndarray) -> np.ndarray:
    """Class of the largest logit; the first of equal ones; missing where any is."""
    out = np.argmax(np.nan_to_num(logits, nan=-np.inf), axis=0).astype(np.float32)
    out[np.isnan(logits).any(axis=0)] = np.nan
    return out


def nullable(v: np.ndarray, there: np.ndarray | None = None) -> pd.arrays.FloatingArray:
    """Numbers for a frame that goes back to Spark, missing where not ``there`` (if not given: where NaN)."""
    v = np.asarray(v, float)
    missing = np.isnan(v) if there is None else ~there
    return pd.arrays.FloatingArray(np.where(missing, 0.0, v), missing)
