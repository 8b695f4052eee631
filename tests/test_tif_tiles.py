"""GeoTIFFs are written tile by tile in tasks."""

import numpy as np
import pytest

from cubelith.cube import Cube
from cubelith.grid import GridSpec
from cubelith.sources import sinks, tiff


def test_tiles_without_the_driver(spark, tmp_path, monkeypatch):
    ny, nx = sinks.TILE + 5, sinks.TILE + 3
    grid = GridSpec("EPSG:3857", (0.0, 10.0, 0.0, 10.0 * ny, 0.0, -10.0), (("x", nx), ("y", ny)), "f64")
    df = spark.createDataFrame([(0, 0, 1.0), (sinks.TILE - 1, sinks.TILE, 2.0), (ny - 1, nx - 1, 3.0)], "y int, x int, b double")
    monkeypatch.setattr(Cube, "collect", lambda self: pytest.fail("collected on the driver"))
    paths = sinks.write_tif(Cube(df, grid, ("b",), ("y", "x"), None, ("cells",)), str(tmp_path / "a.tif"), "i16", nodata=-9)
    whole = np.full((ny, nx), -9)
    whole[0, 0], whole[sinks.TILE - 1, sinks.TILE], whole[-1, -1] = 1, 2, 3
    assert len(paths) == len(set(paths)) == 4
    for p in paths:
        planes, own, nodata = tiff.decode(open(p, "rb").read())
        x, y = round(own.transform[0] / 10), ny - round(own.transform[3] / 10)
        assert nodata == -9 and np.array_equal(planes[0], whole[y : y + own.ny, x : x + own.nx])
    assert sum(tiff.grid_of(p).nx * tiff.grid_of(p).ny for p in paths) == ny * nx


def test_slices(spark, tmp_path):
    grid = GridSpec("EPSG:3857", (0.0, 10.0, 0.0, 10.0, 0.0, -10.0), (("x", 2), ("y", 1)), "f64")
    df = spark.createDataFrame([("2023-01", 0, 0, 1.0), ("2023-02", 0, 1, 2.0)], "t string, y int, x int, b double")
    paths = sinks.write_tif(Cube(df, grid, ("b",), ("t", "y", "x"), None, ("cells",)), str(tmp_path / "a.tif"))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a-2023-01.tif", "a-2023-02.tif"]
    assert np.array_equal(tiff.decode(open(paths[1], "rb").read())[0][0], [[np.nan, 2.0]], equal_nan=True)


def lzw(data):
    """A plain encoder, to test the reader with."""
    codes, table, width, last, bits = [], {}, 9, b"", ""

    def put(code):
        nonlocal bits
        bits += format(code, f"0{width}b")

    put(256)
    table = {bytes([i]): i for i in range(256)}
    for i in range(len(data)):
        c = data[i : i + 1]
        if last + c in table:
            last += c
            continue
        put(table[last])
        table[last + c] = len(table) + 2
        if len(table) + 2 >= 1 << width:
            width += 1
        if len(table) + 2 >= 4095:
            put(256)
            table, width = {bytes([i]): i for i in range(256)}, 9
        last = c
    put(table[last])
    put(257)
    del codes
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def test_lzw():
    rng = np.random.default_rng(0)
    for data in (b"a", b"abababababab" * 50, rng.integers(0, 4, 20_000, np.uint8).tobytes(), rng.integers(0, 256, 9000, np.uint8).tobytes()):
        assert tiff._unlzw(lzw(data)) == data


@pytest.mark.parametrize("dtype", list(tiff._FORMATS))
@pytest.mark.parametrize("compress", ["none", "deflate", "zstd"])
def test_round_trip(dtype, compress):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 100, (2, 70, 45)).astype("<" + tiff._NUMPY[dtype])
    grid = GridSpec("EPSG:32632", (500000.0, 10.0, 0.0, 5000000.0, 0.0, -10.0), (("x", 45), ("y", 70)), dtype)
    raw = tiff.encode(a, grid, dtype, 7, ["red", "n & ir"], 0.5, -1.0, compress, tile=32, overviews=2)
    full, half, *_ = tiff.images(raw)
    assert full.names == ("red", "n & ir") and full.scales == (0.5, 0.5) and full.shifts == (-1.0, -1.0) and half.reduced
    planes, own, nodata = tiff.decode(raw)
    assert np.array_equal(planes, a) and own.transform == grid.transform and own.crs == grid.crs and nodata == 7
    assert np.array_equal(tiff.decode(raw, 1)[0], a[:, ::2, ::2]) and half.grid.ny == 35


def strips(a, order="<", big=False, compression=1, predictor=1, rows=16, affine=False):
    """A file of interleaved strips, as other programs write."""
    import struct
    import zlib

    ny, nx, n = a.shape
    data = []
    for y in range(0, ny, rows):
        part = a[y : y + rows]
        if predictor == 2:
            part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
        raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            size = part.dtype.itemsize
            flat = part.astype(part.dtype.newbyteorder(">")).reshape(len(part), -1)
            planes = flat.view(np.uint8).reshape(len(part), -1, size).transpose(0, 2, 1).reshape(len(part), -1, n)
            raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
        data.append(zlib.compress(raw) if compression == 8 else lzw(raw) if compression == 5 else raw)
    kind, bits = next(v for k, v in tiff._FORMATS.items() if tiff._NUMPY[k] == a.dtype.str[1:])
    word, short, entry, begin = ("Q", 8, 20, 16) if big else ("I", 4, 12, 8)
    tags = [(256, "I", [nx]), (257, "I", [ny]), (258, "H", [bits] * n), (259, "H", [compression]), (273, "I", None), (277, "H", [n]), (278, "I", [rows]), (279, "I", [len(d) for d in data]), (284, "H", [1]), (317, "H", [predictor]), (339, "H", [kind] * n)]
    tags += [(34264, "d", [10.0, 0, 0, 5.0, 0, -10.0, 0, 6.0, 0, 0, 0, 0, 0, 0, 0, 1])] if affine else [(33550, "d", [10.0, 10.0, 0.0]), (33922, "d", [0.0, 0, 0, 5.0, 6.0, 0])]
    after = begin + (8 if big else 2) + entry * len(tags) + short
    size = sum(len(struct.pack("<" + str(len(v or data)) + c, *(v or [0] * len(data)))) + 8 for _, c, v in tags)
    starts = [after + size + sum(map(len, data[:i])) for i in range(len(data))]
    head, more = struct.pack(order + ("Q" if big else "H"), len(tags)), b""
    for tag, c, v in tags:
        v = v or starts
        raw = struct.pack(order + str(len(v)) + c, *v)
        head += struct.pack(order + "HH" + word, tag, {"H": 3, "I": 4, "d": 12}[c], len(v))
        if len(raw) <= short:
            head += raw.ljust(short, b"\0")
        else:
            head += struct.pack(order + word, after + len(more))
            more += raw
    top = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8))
    return (top + head + struct.pack(order + word, 0) + more).ljust(after + size, b"\0") + b"".join(data)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(("dtype", "compression", "predictor"), [("u2", 1, 1), ("i2", 5, 2), ("u1", 8, 2), ("f4", 8, 3), ("f8", 5, 1)])
def test_files_of_other_programs(order, big, dtype, compression, predictor):
    a = np.random.default_rng(2).integers(0, 90, (50, 21, 3)).astype(dtype)
    raw = strips(a, order, big, compression, predictor, affine=big)
    planes, grid, _ = tiff.decode(raw)
    assert np.array_equal(planes, a.transpose(2, 0, 1))
    assert grid.transform == (5.0, 10.0, 0.0, 6.0, 0.0, -10.0)


def test_files_become_cubes(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 90, (2, 300, 280)).astype("<i2")
    grid = GridSpec("EPSG:3857", (0.0, 10.0, 0.0, 3000.0, 0.0, -10.0), (("x", 280), ("y", 300)), "i16")
    for t in ("a", "b"):
        (tmp_path / f"{t}.tif").write_bytes(tiff.encode(a, grid, "i16", 5, ["red", "nir"], 0.1, 1.0))
    cube = tiff.lazy_files(spark, {t: str(tmp_path / f"{t}.tif") for t in ("a", "b")})
    assert cube.bands == ("red", "nir") and cube.grid.labels["t"] == ("a", "b")
    got = cube.select("nir").collect()["b"]
    want = np.where(a[1] == 5, np.nan, a[1] * 0.1 + 1)
    assert np.allclose(got, want, equal_nan=True)
    window = tiff.read_window(tmp_path / "a.tif", 250, -3, 60, 10)
    assert np.array_equal(window[0, :50, 3:], np.where(a[0, 250:, :7] == 5, np.nan, a[0, 250:, :7]), equal_nan=True) and np.isnan(window[:, 50:]).all() and np.isnan(window[:, :, :3]).all()
    (tmp_path / "c.tif").write_bytes(tiff.encode(a, grid, "i16")[:-5])
    with pytest.raises(Exception, match="rror"):
        tiff.read_cells(spark, str(tmp_path / "c.tif")).count()
    from cubelith.plans import options

    options.put(spark, readFail="nodata")
    try:
        assert tiff.read_cells(spark, str(tmp_path / "c.tif")).where("b2 is null").count() == 44 * 24
    finally:
        options.put(spark, readFail="error")
