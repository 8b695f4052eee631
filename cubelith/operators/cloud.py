"""Cloud classes by small convolutional networks over whole windows.

Classes: 0 clear, 1 thick cloud, 2 thin cloud, 3 shadow. A model is a list of networks whose logits are averaged. Weights
are not shipped: any function of ``[3, y, x]`` to ``[4, y, x]`` is a network, and :class:`UNet` runs plain weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from ..cube import Cube
from ..functions import tensors
from .focal import lazy_patch
from .mask import mask

CLASSES = ("clear", "thick cloud", "thin cloud", "shadow")
MULTIPLE = 32  # networks halve a window up to five times


@dataclass(frozen=True)
class UNet:
    """Encoder levels of two 3x3 convolutions with ReLU and halving, a decoder that doubles and joins, and a 1x1 head.

    ``weights``: ``down<i>.w``, ``down<i>.b``, ``up<i>.w``, ``up<i>.b`` from level 0, ``head.w``, ``head.b``.
    """

    weights: dict[str, np.ndarray]

    @property
    def levels(self) -> int:
        return sum(k.startswith("down") and k.endswith(".w") for k in self.weights)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, kept = self.weights, []
        for i in range(self.levels):
            x = np.maximum(tensors.conv2d(x, w[f"down{i}.w"], w[f"down{i}.b"], padding=1), 0)
            if i < self.levels - 1:
                kept.append(x)
                x = x.reshape(x.shape[0], x.shape[1] // 2, 2, x.shape[2] // 2, 2).max(axis=(2, 4))
        for i in range(self.levels - 2, -1, -1):
            x = np.concatenate([tensors.upsample2x(x), kept[i]])
            x = np.maximum(tensors.conv2d(x, w[f"up{i}.w"], w[f"up{i}.b"], padding=1), 0)
        return tensors.conv2d(x, w["head.w"], w["head.b"])


def normalised(x: np.ndarray) -> np.ndarray:
    """Each channel of a window to mean 0 and deviation 1 over its valid cells; missing cells as 0."""
    with np.errstate(all="ignore"):
        mean, sd = np.nanmean(x, axis=(1, 2), keepdims=True), np.nanstd(x, axis=(1, 2), keepdims=True)
    return np.nan_to_num((x - mean) / np.where(sd > 0, sd, 1.0))


def classify(x: np.ndarray, networks: list[Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """``[1, y, x]`` of classes; missing where a channel is, or where a whole window is."""
    invalid = np.isnan(x).any(axis=0)
    if invalid.all():
        return np.full((1, *x.shape[1:]), np.nan)
    padded = tensors.pad_right_bottom(normalised(x), MULTIPLE)
    logits = sum(n(padded) for n in networks) / len(networks)
    out = tensors.first_argmax(logits)[: x.shape[1], : x.shape[2]]
    out[invalid] = np.nan
    return out[None]


def cloud_predict(cube: Cube, red: str, green: str, nir: str, networks: list[Callable], halo: int = 128) -> Cube:
    """A band ``cloud`` of classes, from tiles with a ring of ``halo`` cells.

    Normalisation is of each window, so classes near a decision can depend on the tiling.
    """
    return lazy_patch(cube.select(red, green, nir), lambda x: classify(x, networks), halo, ("cloud",))


def cloud_mask(cube: Cube, red: str, green: str, nir: str, networks: list[Callable], where: tuple[int, ...] = (1, 2, 3), open_: int = 0, dilate_: int = 0, halo: int = 128) -> Cube:
    """The cube with cells of cloudy classes missing."""
    found = cloud_predict(cube, red, green, nir, networks, halo)
    return mask(replace(cube, mask_asset=None), found, [float(c) for c in where], open_, dilate_)
