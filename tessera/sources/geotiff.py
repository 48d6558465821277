"""GeoTIFF files as rasters, classic and big ones: strips or tiles, plain or compressed (deflate, LZW, Zstandard), with predictors.

The driver reads the directory; a task reads and unpacks the blocks that it is given by their byte ranges.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..grid import GridError, Raster
from .zarr import SPARK_TYPES, _fs

#: The format's field types, tags and compressions.
KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 254, 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
PLAIN, LZW, DEFLATE, OLD_DEFLATE, ZSTD = 1, 5, 8, 32946, 50000


def directories(data: Any) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and the tags of each directory of an open file."""

    def read(at: int, n: int) -> bytes:
        data.seek(at)
        return data.read(n)

    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(order + "H", head[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    word, count_kind, size = ("Q", "Q", 20) if version == 43 else ("I", "H", 12)
    inline, at = struct.calcsize(word), struct.unpack(order + word, head[8:16] if version == 43 else head[4:8])[0]
    while at:
        n = struct.unpack(order + count_kind, read(at, struct.calcsize(count_kind)))[0]
        at += struct.calcsize(count_kind)
        rows, tags = read(at, n * size + inline), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HH" + word, rows, k * size)
            if kind in KINDS:
                length = count * struct.calcsize(KINDS[kind])
                place = k * size + size - inline
                raw = rows[place : place + length] if length <= inline else read(struct.unpack_from(order + word, rows, place)[0], length)
                tags[tag] = (raw.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{KINDS[kind]}", raw)
        yield order, tags
        at = struct.unpack_from(order + word, rows, n * size)[0]


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, held, bits, width, last = bytearray(), [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([b]) for b in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


def unpack(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return unpack_lzw(data)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {compression} isn't supported")


@dataclass(frozen=True)
class Tiff:
    """One image: its shape (bands, rows, columns), type, blocks and place."""

    path: str
    shape: tuple[int, int, int]
    dtype: str
    order: str
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    planar: bool
    xs: np.ndarray
    ys: np.ndarray
    crs: str | None
    nodata: float | None

    @classmethod
    def open(cls, path: str) -> Tiff:
        system, at = _fs(path)
        with system.open_input_file(at) as f:
            images = [(o, t) for o, t in directories(f) if not t.get(SUBFILE, (0,))[0] & 5]  # neither overviews nor masks
        if len(images) != 1:
            raise GridError(f"{path} has {len(images)} images; one is read")
        order, t = images[0]
        bands, ny, nx = t.get(SAMPLES, (1,))[0], t[HEIGHT][0], t[WIDTH][0]
        kind = {1: "uint", 2: "int", 3: "float"}[t.get(FORMAT, (1,))[0]]
        if len(set(t[BITS])) > 1 or t[BITS][0] not in (8, 16, 32, 64):
            raise GridError(f"{path} has samples of {t[BITS]} bits")
        if PIXEL_SCALE not in t or TIE_POINT not in t:
            raise GridError(f"{path} has no regular place")
        block = (t[TILE_HEIGHT][0], t[TILE_WIDTH][0]) if TILES in t else (min(ny, t.get(STRIP_ROWS, (ny,))[0]), nx)
        keys = t.get(GEO_KEYS, ())
        geo = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        code = geo.get(3072) or geo.get(2048)
        half = 0.0 if geo.get(1025) == 2 else 0.5
        (dx, dy, *_), (i, j, _, x, y, *_) = t[PIXEL_SCALE], t[TIE_POINT]
        try:
            nodata = float(t[NODATA][0])
        except (KeyError, ValueError):
            nodata = None
        planar = t.get(PLANAR, (1,))[0] == 2 and bands > 1
        xs, ys = x + dx * (np.arange(nx) - i + half), y - dy * (np.arange(ny) - j + half)
        return cls(path, (bands, ny, nx), f"{kind}{t[BITS][0]}", order, block, t.get(TILES) or t[STRIPS], t.get(TILE_SIZES) or t[STRIP_SIZES], t.get(COMPRESSION, (1,))[0], t.get(PREDICTOR, (1,))[0], planar, xs, ys, f"EPSG:{code}" if code and code != 32767 else None, nodata)

    def place(self, n: int) -> tuple[int, int, int]:
        """First band, row and column of a block."""
        across = math.ceil(self.shape[2] / self.block[1])
        each = across * math.ceil(self.shape[1] / self.block[0])
        return n // each, n % each // across * self.block[0], n % across * self.block[1]

    def read(self, n: int) -> np.ndarray | None:
        """A block's values by band, row and column, cut to the image; nothing if it isn't stored."""
        if not self.sizes[n]:
            return None
        system, at = _fs(self.path)
        with system.open_input_file(at) as f:
            f.seek(self.offsets[n])
            data = unpack(f.read(self.sizes[n]), self.compression)
        kind = np.dtype(self.dtype).newbyteorder(self.order)
        samples, width = 1 if self.planar else self.shape[0], self.block[1]
        line = width * samples * kind.itemsize
        rows = min(self.block[0], len(data) // line)
        raw = np.frombuffer(data, np.uint8, rows * line).reshape(rows, line)
        if self.predictor == 3:  # bytes by significance, each row's differences
            raw = np.add.accumulate(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            raw = np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(rows, line)
            kind = np.dtype(self.dtype).newbyteorder(">")
        values = raw.view(kind).reshape(rows, width, samples).astype(self.dtype)
        if self.predictor == 2:
            values = np.add.accumulate(values, axis=1, dtype=values.dtype)
        _, y, x = self.place(n)
        return values.transpose(2, 0, 1)[:, : self.shape[1] - y, : self.shape[2] - x]

    def rows(self, n: int, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        found = self.read(n)
        if found is None:
            return
        band, y, x = self.place(n)
        many, kind = self.shape[0] > 1, {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}.get(self.dtype, np.dtype(self.dtype))
        for k in range(0, found.size, step):
            b, r, c = np.unravel_index(np.arange(k, min(found.size, k + step)), found.shape)
            columns = [pa.array(self.ys[y + r]), pa.array(self.xs[x + c]), pa.array(found[b, r, c].astype(kind))]
            yield pa.RecordBatch.from_arrays([pa.array((band + b + 1).astype(np.int32)), *columns] if many else columns, names=[*["band"] * many, "y", "x", "band_data"])


def open_geotiff(spark: SparkSession, path: str) -> Raster:
    """A file's image as a raster with the variable ``band_data``; several bands are a dimension ``band``."""
    image = Tiff.open(path)
    if image.dtype not in SPARK_TYPES or image.dtype == "uint64":
        raise GridError(f"{path} has values of type {image.dtype}")
    many, n = image.shape[0] > 1, len(image.offsets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from image.rows(k)

    fields = [T.StructField("band", T.IntegerType())] * many + [T.StructField("y", T.DoubleType()), T.StructField("x", T.DoubleType()), T.StructField("band_data", SPARK_TYPES[image.dtype])]
    attrs = {"dtype": image.dtype} | ({"_FillValue": image.nodata if image.dtype.startswith("float") else int(image.nodata)} if image.nodata is not None else {})
    axes = {"x": image.xs, "y": np.sort(image.ys)} | ({"band": np.arange(1, image.shape[0] + 1)} if many else {})
    return Raster(spark.range(0, n, 1, n).mapInArrow(run, T.StructType(fields)), (*["band"] * many, "y", "x"), {"band_data": attrs}, attrs={"crs": image.crs} if image.crs else {}, axes=axes)
