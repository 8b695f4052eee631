"""GeoTIFF and BigTIFF: tiles or strips, plain, DEFLATE, LZW or Zstandard, with predictors, overviews, band names and scales.

Files are read by Spark: a file's compressed tiles become rows, these are dealt out, and each is decoded by
itself; so a task decodes one tile at a time.  Spark's reader of whole files takes files of up to 2 GB.
"""

from __future__ import annotations

import mmap
import re
import struct
import zlib
from dataclasses import dataclass, replace
from pathlib import Path
from xml.sax.saxutils import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube
from ..errors import PlanError, WriteError
from ..functions.cells import dequantize
from ..grid import GridSpec
from ..plans import options

# fixed values: tag numbers, field types, sample formats by dtype, and numbers of compressions
_TAGS = {"level": 254, "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325, "format": 339, "scale": 33550, "tie": 33922, "affine": 34264, "geo": 34735, "metadata": 42112, "nodata": 42113}
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
_FORMATS = {"u8": (1, 8), "u16": (1, 16), "u32": (1, 32), "i8": (2, 8), "i16": (2, 16), "i32": (2, 32), "f32": (3, 32), "f64": (3, 64)}
_NUMPY = {"u8": "u1", "u16": "u2", "u32": "u4", "i8": "i1", "i16": "i2", "i32": "i4", "f32": "f4", "f64": "f8"}
_COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8, "zstd": 50000}
_OLD_DEFLATE = 32946


@dataclass(frozen=True)
class Image:
    """One image of a file: where its tiles (or strips) lie and what its samples mean."""

    grid: GridSpec
    samples: int
    order: str
    compression: int
    predictor: int
    apart: bool  # bands in tiles of their own
    tile: tuple[int, int]  # rows and columns
    offsets: tuple[int, ...]
    counts: tuple[int, ...]
    nodata: float | None
    names: tuple[str, ...]
    scales: tuple[float, ...]
    shifts: tuple[float, ...]
    reduced: bool

    @property
    def tiles(self) -> tuple[int, int]:
        return -(-self.grid.ny // self.tile[0]), -(-self.grid.nx // self.tile[1])

    def place(self, number: int) -> tuple[int, int, int]:
        """First band, first row and first column of a tile."""
        down, across = self.tiles
        band, inside = divmod(number, down * across) if self.apart else (0, number)
        return band, inside // across * self.tile[0], inside % across * self.tile[1]


def images(raw) -> list[Image]:
    """The images of a file's bytes, the full one first."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(raw[:2]))
    if order is None:
        raise PlanError("not a TIFF file")
    (version,) = struct.unpack_from(order + "H", raw, 2)
    big = version == 43
    if version not in (42, 43):
        raise PlanError("not a TIFF file")
    word, entry = ("Q", 20) if big else ("I", 12)
    (at,) = struct.unpack_from(order + word, raw, 8 if big else 4)
    out: list[Image] = []
    while at:
        (n,) = struct.unpack_from(order + ("Q" if big else "H"), raw, at)
        first = at + (8 if big else 2)
        tags: dict[int, list] = {}
        for i in range(n):
            here = first + entry * i
            tag, kind, count = struct.unpack_from(order + "HH" + word, raw, here)
            if kind not in _TYPES:
                continue
            size = struct.calcsize("=" + _TYPES[kind]) * count
            value = here + (12 if big else 8)
            if size > (8 if big else 4):
                (value,) = struct.unpack_from(order + word, raw, value)
            tags[tag] = [bytes(raw[value : value + count])] if kind == 2 else list(struct.unpack_from(f"{order}{count}{_TYPES[kind]}", raw, value))
        (at,) = struct.unpack_from(order + word, raw, first + entry * n)
        out.append(_image(tags, order, out[0] if out else None))
    return out


def _image(tags: dict[int, list], order: str, full: Image | None) -> Image:
    get = lambda name, default=None: tags.get(_TAGS[name], default)
    nx, ny, n = get("width")[0], get("height")[0], get("samples", [1])[0]
    dtype = next((k for k, v in _FORMATS.items() if v == (get("format", [1])[0], get("bits", [1])[0])), None)
    if dtype is None:
        raise PlanError(f"samples of format {get('format', [1])[0]} and {get('bits', [1])[0]} bits are not read")
    if affine := get("affine"):
        transform = (affine[3], affine[0], affine[1], affine[7], affine[4], affine[5])
    elif get("scale"):
        (w, h), tie = get("scale")[:2], get("tie", [0.0] * 6)
        transform = (tie[3] - tie[0] * w, w, 0.0, tie[4] + tie[1] * h, 0.0, -h)
    elif full is not None:  # an overview covers what the full image does
        x0, w, b, y0, c, h = full.grid.transform
        transform = (x0, w * full.grid.nx / nx, b, y0, c, h * full.grid.ny / ny)
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    geo = get("geo", [])
    epsg = next((geo[i + 3] for i in range(4, len(geo) - 3, 4) if geo[i] in (2048, 3072)), None)
    crs = f"EPSG:{epsg}" if epsg else (full.grid.crs if full else "EPSG:3857")
    text = get("nodata", [b""])[0].rstrip(b"\0 ").decode("ascii", "replace")
    said = get("metadata", [b""])[0].rstrip(b"\0").decode("utf-8", "replace")
    items: dict[tuple[str, int], str] = {}
    for head, value in re.findall(r"<Item([^>]*)>([^<]*)</Item>", said):
        at, role = re.search(r'sample="(\d+)"', head), re.search(r'role="(\w+)"', head)
        if at and role:
            items[role[1], int(at[1])] = unescape(value)
    tiled = get("tile_width") is not None
    return Image(
        GridSpec(crs, transform, (("x", nx), ("y", ny)), dtype), n, order, get("compression", [1])[0], get("predictor", [1])[0], get("planar", [1])[0] == 2 and n > 1,
        (get("tile_height")[0], get("tile_width")[0]) if tiled else (min(ny, get("rows", [ny])[0]), nx),
        tuple(get("tile_offsets" if tiled else "offsets")), tuple(get("tile_counts" if tiled else "counts")), float(text) if text else (full.nodata if full else None),
        tuple(items.get(("description", i), f"b{i + 1}") for i in range(n)), tuple(float(items.get(("scale", i), 1)) for i in range(n)), tuple(float(items.get(("offset", i), 0)) for i in range(n)),
        bool(get("level", [0])[0] & 1),
    )


def _unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bit first."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not last:
            found = table[code]
        else:
            found = table[code] if code < len(table) else last + last[:1]
            table.append(last + found[:1])
        out += found
        last = found
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def decode_tile(image: Image, number: int, raw: bytes) -> np.ndarray:
    """``[band, y, x]`` of a tile's bytes, cut to the image; one band if bands lie apart."""
    n = 1 if image.apart else image.samples
    kind = np.dtype(_NUMPY[image.grid.dtype]).newbyteorder(image.order)
    _, y0, x0 = image.place(number)
    down, across = image.tile
    if image.compression in (_COMPRESSIONS["deflate"], _OLD_DEFLATE):
        raw = zlib.decompress(raw)
    elif image.compression == _COMPRESSIONS["lzw"]:
        raw = _unlzw(raw)
    elif image.compression == _COMPRESSIONS["zstd"]:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=down * across * n * kind.itemsize)
    elif image.compression != 1:
        raise PlanError(f"compression {image.compression} is not read")
    rows = len(raw) // (across * n * kind.itemsize)  # a last strip is short
    if image.predictor == 3:
        steps = np.frombuffer(raw, np.uint8, rows * across * n * kind.itemsize).reshape(rows, across * n * kind.itemsize)
        sums = np.cumsum(steps.reshape(rows, -1, n), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, across * n)
        flat = np.ascontiguousarray(sums.transpose(0, 2, 1)).view(kind.newbyteorder(">"))[..., 0].reshape(rows, across, n)
    else:
        flat = np.frombuffer(raw, kind, rows * across * n).reshape(rows, across, n)
        if image.predictor == 2:
            flat = np.cumsum(flat, axis=1, dtype=kind.newbyteorder("="))
    return flat[: image.grid.ny - y0, : image.grid.nx - x0].transpose(2, 0, 1)


def decode(raw: bytes, level: int = 0) -> tuple[np.ndarray, GridSpec, float | None]:
    """``[band, y, x]``, grid and nodata of a file's bytes; ``level`` counts overviews from 1."""
    image = images(raw)[level]
    planes = np.zeros((image.samples, image.grid.ny, image.grid.nx), np.dtype(_NUMPY[image.grid.dtype]))
    for i, (at, size) in enumerate(zip(image.offsets, image.counts, strict=True)):
        band, y, x = image.place(i)
        got = decode_tile(image, i, bytes(raw[at : at + size]))
        planes[band : band + got.shape[0], y : y + got.shape[1], x : x + got.shape[2]] = got
    return planes, image.grid, image.nodata


def open_images(path: str | Path) -> list[Image]:
    """Images of a local file; only its tags are read."""
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        return images(m)


def grid_of(path: str | Path) -> GridSpec:
    """Grid of a local file from its tags."""
    return open_images(path)[0].grid


def read_window(path: str | Path, y0: int, x0: int, ny: int, nx: int, level: int = 0) -> np.ndarray:
    """``[band, y, x]`` of a window of a local file, from the tiles that it touches; missing outside and at nodata."""
    out = None
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        image = images(m)[level]
        out = np.full((image.samples, ny, nx), np.nan)
        for i, (at, size) in enumerate(zip(image.offsets, image.counts, strict=True)):
            band, ty, tx = image.place(i)
            top, left, bottom, right = max(ty, y0), max(tx, x0), min(ty + image.tile[0], y0 + ny, image.grid.ny), min(tx + image.tile[1], x0 + nx, image.grid.nx)
            if top < bottom and left < right:
                got = decode_tile(image, i, m[at : at + size]).astype(float)
                out[band : band + len(got), top - y0 : bottom - y0, left - x0 : right - x0] = got[:, top - ty : bottom - ty, left - tx : right - tx]
    if image.nodata is not None:
        out[out == image.nodata] = np.nan
    return out


def _packed(block: np.ndarray, compress: str, predictor: int) -> bytes:
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
    raw = np.ascontiguousarray(block).tobytes()
    if compress == "deflate":
        return zlib.compress(raw, 6)
    if compress == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=9).compress(raw)
    return raw


def encode(planes: np.ndarray, grid: GridSpec, dtype: str, nodata: float | None = None, names: list[str] | None = None, scale: float | None = None, offset: float | None = None, compress: str = "deflate", tile: int = 256, overviews: int = 0) -> bytes:
    """A file of ``[band, y, x]`` in tiles, bands apart: tags first, then overviews from the smallest, then the full image.

    BigTIFF where the samples take more than 4 GB.
    """
    if dtype not in _FORMATS:
        raise WriteError(f"no TIFF type for {dtype}")
    if compress not in ("none", "deflate", "zstd"):
        raise WriteError(f"compression {compress!r} is not written")
    n = len(planes)
    kind, bits = _FORMATS[dtype]
    predictor = 2 if compress != "none" and kind != 3 else 1
    big = planes[0].size * n * bits // 8 > 4_000_000_000
    epsg = int(grid.crs.split(":")[1]) if grid.crs.startswith("EPSG:") else 32767
    degrees = epsg == 4326
    said = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(b)}</Item>' for i, b in enumerate(names or []))
    if scale is not None or offset is not None:
        said += "".join(f'<Item name="SCALE" sample="{i}" role="scale">{scale if scale is not None else 1.0!r}</Item><Item name="OFFSET" sample="{i}" role="offset">{offset or 0.0!r}</Item>' for i in range(n))
    levels = [np.ascontiguousarray(planes, dtype="<" + _NUMPY[dtype])]
    for _ in range(overviews):
        if max(levels[-1].shape[1:]) <= tile:
            break
        levels.append(levels[-1][:, ::2, ::2])  # the nearest cell
    data: list[list[bytes]] = []
    for own in levels:
        padded = np.pad(own, ((0, 0), (0, -own.shape[1] % tile), (0, -own.shape[2] % tile)), mode="edge")
        data.append([_packed(padded[b, y : y + tile, x : x + tile], compress, predictor) for b in range(n) for y in range(0, padded.shape[1], tile) for x in range(0, padded.shape[2], tile)])
    x0, w, shear_x, y0, shear_y, h = grid.transform
    plain = shear_x == shear_y == 0 and h < 0
    word, short, entry = ("Q", 8, 20) if big else ("I", 4, 12)

    def entries(level: int, starts: list[int]) -> list[tuple[int, int, list]]:
        own = levels[level]
        found = [
            (_TAGS["width"], 4, [own.shape[2]]), (_TAGS["height"], 4, [own.shape[1]]), (_TAGS["bits"], 3, [bits] * n), (_TAGS["compression"], 3, [_COMPRESSIONS[compress]]), (_TAGS["photometric"], 3, [1]),
            (_TAGS["samples"], 3, [n]), (_TAGS["planar"], 3, [2]), (_TAGS["predictor"], 3, [predictor]), (_TAGS["tile_width"], 3, [tile]), (_TAGS["tile_height"], 3, [tile]),
            (_TAGS["tile_offsets"], 16 if big else 4, starts), (_TAGS["tile_counts"], 4, [len(d) for d in data[level]]), (_TAGS["format"], 3, [kind] * n),
        ]
        if level:
            found.append((_TAGS["level"], 4, [1]))
        else:
            found += [(_TAGS["scale"], 12, [w, -h, 0.0]), (_TAGS["tie"], 12, [0.0, 0.0, 0.0, x0, y0, 0.0])] if plain else [(_TAGS["affine"], 12, [w, shear_x, 0.0, x0, shear_y, h, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0])]
            found.append((_TAGS["geo"], 3, [1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg]))
            if said:
                found.append((_TAGS["metadata"], 2, [f"<GDALMetadata>{said}</GDALMetadata>".encode() + b"\0"]))
        if nodata is not None:
            found.append((_TAGS["nodata"], 2, [f"{nodata:g}".encode() + b"\0"]))
        return sorted(found)

    def directory(level: int, at: int, starts: list[int], after: int) -> bytes:
        own = entries(level, starts)
        head, more = struct.pack("<" + ("Q" if big else "H"), len(own)), b""
        end = at + len(head) + entry * len(own) + short
        for tag, code, values in own:
            value = values[0] if code == 2 else struct.pack(f"<{len(values)}{_TYPES[code]}", *values)
            head += struct.pack("<HH" + word, tag, code, len(value) if code == 2 else len(values))
            if len(value) <= short:
                head += value.ljust(short, b"\0")
            else:
                head += struct.pack("<" + word, end + len(more))
                more += value + b"\0" * (-len(value) % 8)
        return head + struct.pack("<" + word, after) + more

    begin = 16 if big else 8
    sizes = [len(directory(i, 0, [0] * len(d), 0)) for i, d in enumerate(data)]
    where = [begin + sum(s + -s % 8 for s in sizes[:i]) for i in range(len(sizes))]
    at, starts = begin + sum(s + -s % 8 for s in sizes), [[] for _ in data]
    for i in reversed(range(len(data))):  # the smallest overview first
        for d in data[i]:
            starts[i].append(at)
            at += len(d)
    out = b"II" + (struct.pack("<HHHQ", 43, 8, 0, 16) if big else struct.pack("<HI", 42, 8))
    for i in range(len(data)):
        out += directory(i, where[i], starts[i], where[i + 1] if i + 1 < len(data) else 0)
        out += b"\0" * (-len(out) % 8)
    return out + b"".join(d for own in reversed(data) for d in own)


def read_cells(spark: SparkSession, paths: str | list[str], level: int = 0) -> DataFrame:
    """``location, y, x, b1 ...`` of files of the same number of bands; missing values are NULL, scales are not applied.

    Each file's compressed tiles are rows, dealt out and decoded one by one.  The option ``readFail`` says whether a tile that can't be
    decoded stops the query or reads as missing.
    """
    files = spark.read.format("binaryFile").load(paths)
    first = files.select("content").first()
    if first is None:
        raise PlanError("no file")
    image = images(bytes(first.content))[level]
    n, names, lenient = image.samples, [f"b{i + 1}" for i in range(image.samples)], options.get(spark, "readFail") == "nodata"

    def split(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                raw, location = content.as_py(), path.as_py()
                own = images(raw)[level]
                if own.samples != n:
                    raise PlanError(f"{location} has {own.samples} bands, the first file {n}")
                down, across = own.tiles
                for i in range(down * across):
                    parts = [raw[own.offsets[k] : own.offsets[k] + own.counts[k]] for k in (range(i, len(own.offsets), down * across) if own.apart else [i])]
                    yield pa.RecordBatch.from_pydict({"location": [location], "tile": [i], "parts": [parts], "tags": [repr(_plain(own))]}, schema=layout)

    layout = pa.schema([("location", pa.string()), ("tile", pa.int32()), ("parts", pa.list_(pa.binary())), ("tags", pa.string())])
    tiles = files.select("path", "content").mapInArrow(split, "location string, tile int, parts array<binary>, tags string").repartition("location", "tile")
    schema = "location string, y int, x int, " + ", ".join(f"{b} double" for b in names)

    def cells(batches):
        for b in batches:
            for r in b.to_pylist():
                own = _whole(r["tags"])
                down, across = own.tiles
                _, y0, x0 = own.place(r["tile"])
                try:
                    got = np.concatenate([decode_tile(own, r["tile"] + k * down * across, p) for k, p in enumerate(r["parts"])]).astype(float)
                except (zlib.error, ValueError, PlanError):
                    if not lenient:
                        raise
                    got = np.full((n, min(own.tile[0], own.grid.ny - y0), min(own.tile[1], own.grid.nx - x0)), np.nan)
                if own.nodata is not None:
                    got[got == own.nodata] = np.nan
                yy, xx = np.mgrid[y0 : y0 + got.shape[1], x0 : x0 + got.shape[2]]
                values = [pa.array(p.ravel(), from_pandas=True) for p in got]
                yield pa.RecordBatch.from_arrays([pa.array([r["location"]] * yy.size), pa.array(yy.ravel().astype(np.int32)), pa.array(xx.ravel().astype(np.int32)), *values], ["location", "y", "x", *names])

    return tiles.mapInArrow(cells, schema)


def _plain(image: Image) -> tuple:
    """What decoding needs, as plain values."""
    g = image.grid
    return (g.crs, tuple(g.transform), g.nx, g.ny, g.dtype, image.samples, image.order, image.compression, image.predictor, image.apart, image.tile, image.nodata)


def _whole(said: str) -> Image:
    from ast import literal_eval

    crs, transform, nx, ny, dtype, samples, order, compression, predictor, apart, tile, nodata = literal_eval(said)
    return Image(GridSpec(crs, transform, (("x", nx), ("y", ny)), dtype), samples, order, compression, predictor, apart, tile, (), (), nodata, (), (), (), False)


def lazy_files(spark: SparkSession, paths: str | list[str] | dict[str, str], level: int = 0) -> Cube:
    """A cube of files on one grid: bands by their names, scales and offsets applied; a dict of paths by label gives slices.

    The grid is discovered from the first file; the others must lie on it.
    """
    named = paths if isinstance(paths, dict) else {"": p for p in ([paths] if isinstance(paths, str) else paths)}
    if not isinstance(paths, dict) and not isinstance(paths, str) and len(paths) > 1:
        raise PlanError("several files need labels of slices: give a dict")
    df = read_cells(spark, list(named.values()), level)
    raw = spark.read.format("binaryFile").load(next(iter(named.values()))).select("content").first()
    image = images(bytes(raw.content))[level]
    touched = any(s != 1 for s in image.scales) or any(image.shifts)
    own = [(dequantize(F.col(f"b{i + 1}"), image.scales[i], image.shifts[i], None) if touched else F.col(f"b{i + 1}")).alias(b) for i, b in enumerate(image.names)]
    axes: tuple[str, ...] = ("y", "x")
    grid = replace(image.grid, dtype="f64")
    if isinstance(paths, dict):
        axes = ("t", "y", "x")
        labels = spark.createDataFrame([(p.rsplit("/", 1)[-1], t) for t, p in named.items()], "_file string, t string")
        df = df.withColumn("_file", F.substring_index("location", "/", -1)).join(F.broadcast(labels), "_file")
        grid = grid.stacked("t", list(named))
    return Cube(df.select(*axes, *own), grid, image.names, axes, None, (f"files {len(named)}",), True)


def raw_cube_info(path: str | Path) -> dict:
    """Shape and type of a raw band-sequential cube beside its small header (``key=value`` lines)."""
    found = dict(line.split("=", 1) for line in Path(path).read_text().splitlines() if "=" in line)
    return {"bands": int(found["bands"]), "ny": int(found["ny"]), "nx": int(found["nx"]), "dtype": found["dtype"]}


def write_raw_cube(path: str | Path, planes: np.ndarray, dtype: str = "f32") -> None:
    n, ny, nx = planes.shape
    np.ascontiguousarray(planes, dtype="<" + _NUMPY[dtype]).tofile(str(path) + ".bin")
    Path(path).write_text(f"bands={n}\nny={ny}\nnx={nx}\ndtype={dtype}\n")


def read_raw_window(path: str | Path, band: int, y0: int, x0: int, ny: int, nx: int) -> np.ndarray:
    """A window of one band (from 0), by mapping the file."""
    i = raw_cube_info(path)
    m = np.memmap(str(path) + ".bin", dtype="<" + _NUMPY[i["dtype"]], mode="r", shape=(i["bands"], i["ny"], i["nx"]))
    return np.array(m[band, y0 : y0 + ny, x0 : x0 + nx])


def with_dtype(grid: GridSpec, dtype: str) -> GridSpec:
    return replace(grid, dtype=dtype)
