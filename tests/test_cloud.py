import numpy as np

from cubelith.operators import cloud
from test_cubes import plane


def _unet():
    rng = np.random.default_rng(0)
    w = lambda *s: rng.normal(size=s) * 0.3
    return cloud.UNet({"down0.w": w(4, 3, 3, 3), "down0.b": w(4), "down1.w": w(6, 4, 3, 3), "down1.b": w(6), "up0.w": w(4, 10, 3, 3), "up0.b": w(4), "head.w": w(4, 4, 1, 1), "head.b": w(4)})


def test_classes_of_a_window():
    rng = np.random.default_rng(1)
    x = rng.random((3, 37, 41))
    x[0, 3, 4] = np.nan
    got = cloud.classify(x, [_unet(), _unet()])
    assert got.shape == (1, 37, 41) and np.isnan(got[0, 3, 4]) and set(np.unique(got[~np.isnan(got)])) <= {0, 1, 2, 3}
    assert np.isnan(cloud.classify(np.full((3, 8, 8), np.nan), [_unet()])).all()
    assert np.array_equal(got, cloud.classify(x, [_unet()]), equal_nan=True)


def test_mask_by_a_network(spark):
    a = np.zeros((6, 7, 3))
    a[2, 3] = 9
    bright = lambda x: np.stack([-x[0], x[0], x[0] * 0 - 9, x[0] * 0 - 9])
    c = plane(spark, a, ("red", "green", "nir"))
    got = cloud.cloud_mask(c, "red", "green", "nir", [bright], halo=2)
    assert np.isnan(got.collect()).sum() == 3
