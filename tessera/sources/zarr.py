"""Zarr v3: pyramids as sharded arrays, and back.

A task writes whole shards (or chunks), so no two tasks touch a file. Inner chunks lie in a shard with an index of offsets
and lengths and its CRC-32C at the end. Two presets: ``web`` (Blosc with Zstandard, bits of floats and bytes of whole
numbers shuffled, chunks in lexicographic order) and ``zstd`` (plain Zstandard, Morton order).
Paths are those of ``pyarrow.fs``: local or shared folders, ``s3://``, ``gs://``, ``hdfs://``.
"""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cache
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..grid import Raster, Variable
from ..metadata import jsonable
from ..store import Pyramid
from . import blosc

EMPTY = (1 << 64) - 1
PRESETS = ("web", "zstd")
SPARK_TYPES = {"float32": T.FloatType(), "float64": T.DoubleType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "bool": T.BooleanType(), "float16": T.FloatType()}


@cache
def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


def crc32c(data: bytes) -> int:
    table, crc = _crc_table(), 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    system, at = _fs(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data)


def _get(path: str) -> bytes | None:
    system, at = _fs(path)
    try:
        with system.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None


def morton(index: tuple[int, ...]) -> int:
    """The place of a chunk in Morton order."""
    return sum((n >> bit & 1) << (bit * len(index) + len(index) - 1 - d) for bit in range(24) for d, n in enumerate(index))


def check_preset(preset: str, level: int) -> None:
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset!r}; there are {PRESETS}")
    if isinstance(level, bool) or not isinstance(level, int) or preset == "web" and not 0 <= level <= 9:
        raise ValueError(f"the compression level of {preset!r} is a whole number" + " from 0 to 9" * (preset == "web"))


def press(values: np.ndarray, preset: str, level: int) -> bytes:
    """A chunk's bytes, compressed."""
    import zstandard

    data = np.ascontiguousarray(values).tobytes()
    if preset == "web":
        return blosc.compress(data, values.dtype.itemsize, level, values.dtype.kind == "f")
    return zstandard.ZstdCompressor(level=level).compress(data)


def unpress(data: bytes, codec: str, size: int) -> bytes:
    import zstandard

    return blosc.decompress(data) if codec == "blosc" else zstandard.ZstdDecompressor().decompress(data, max_output_size=size)


def encode_shard(block: np.ndarray, chunk: tuple[int, ...], fill: Any, preset: str, level: int) -> bytes | None:
    """A shard's file, or nothing if every chunk is fill. ``block`` has whole chunks."""
    counts = tuple(s // c for s, c in zip(block.shape, chunk, strict=True))
    index = np.full((*counts, 2), EMPTY, np.uint64)
    body = bytearray()
    for at in sorted(product(*map(range, counts)), key=None if preset == "web" else morton):
        part = block[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))]
        if not is_fill(part, fill):
            data = press(part, preset, level)
            index[at] = len(body), len(data)
            body += data
    if not body:
        return None
    tail = index.astype("<u8").tobytes()
    return bytes(body) + tail + struct.pack("<I", crc32c(tail))


def decode_shard(data: bytes, shard: tuple[int, ...], chunk: tuple[int, ...], dtype: str, fill: Any, codec: str) -> np.ndarray:
    counts = tuple(s // c for s, c in zip(shard, chunk, strict=True))
    size = 16 * math.prod(counts)
    tail = data[-size - 4 : -4]
    if crc32c(tail) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a shard's index is damaged")
    index, out = np.frombuffer(tail, "<u8").reshape(*counts, 2), np.full(shard, fill, dtype)
    for at in np.ndindex(*counts):
        start, n = (int(v) for v in index[at])
        if start != EMPTY:
            raw = unpress(data[start : start + n], codec, math.prod(chunk) * np.dtype(dtype).itemsize)
            out[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunk, strict=True))] = np.frombuffer(raw, dtype).reshape(chunk)
    return out


def is_fill(part: np.ndarray, fill: Any) -> bool:
    return bool(np.isnan(part).all()) if isinstance(fill, float) and math.isnan(fill) else bool((part == fill).all())


def _codecs(v: Variable, preset: str, level: int) -> list[dict[str, Any]]:
    plain = {"name": "bytes", "configuration": {"endian": "little"}}
    if preset == "web":
        return [plain, {"name": "blosc", "configuration": {"cname": "zstd", "clevel": level, "shuffle": "bitshuffle" if v.kind == "f" else "shuffle", "typesize": v.itemsize, "blocksize": 0}}]
    return [plain, {"name": "zstd", "configuration": {"level": level, "checksum": False}}]


def array_doc(v: Variable, shape: tuple[int, ...], chunks: tuple[int, ...], shards: tuple[int, ...] | None, attrs: dict[str, Any], preset: str, level: int) -> dict[str, Any]:
    codecs = _codecs(v, preset, level)
    if shards:
        codecs = [{"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunks), "codecs": codecs, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}]
    fill = "NaN" if v.kind == "f" else bool(v.fill) if v.kind == "b" else int(v.fill)
    return {
        "zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": v.dtype, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(shards or chunks)}},
        "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": codecs, "attributes": jsonable(attrs), "dimension_names": list(v.dims), "storage_transformers": [],
    }


def export(pyramid: Pyramid, path: str, preset: str = "web", level: int = 3) -> None:
    """Writes a stored pyramid as a Zarr v3 hierarchy; metadata is consolidated in every level's group, then in the root."""
    check_preset(preset, level)
    plan, root, extra = pyramid.plan, path.rstrip("/"), pyramid.doc["grid"]["extra"]
    docs: dict[str, Any] = {}
    source = {v["name"]: v["attrs"] for v in pyramid.doc["variables"]}
    for at in plan.levels:
        own = pyramid.doc["levels"][str(at.index)]
        docs[str(at.index)] = {"zarr_format": 3, "node_type": "group", "attributes": own["attrs"]}
        alike: dict[Any, list[Variable]] = {}
        for v in plan.grid.variables:
            lay = at.layouts[v.name]
            docs[f"{at.index}/{v.name}"] = array_doc(v, at.shapes[v.name], lay.chunks, lay.shards, source[v.name] | own["arrays"][v.name], preset, level)
            alike.setdefault((v.dims, lay.unit), []).append(v)
        for (dims, unit), variables in alike.items():
            export_arrays(pyramid.level(at.index), variables, {v.name: at.layouts[v.name] for v in variables}, dims, unit, extra, f"{root}/{at.index}", preset, level)
        a, _, c, _, e, f = at.transform
        axes = {plan.grid.y: f + e * (np.arange(at.shape[0]) + 0.5), plan.grid.x: c + a * (np.arange(at.shape[1]) + 0.5)}
        axes |= {d: np.array(values, np.float64) for d, values in extra.items() if values and all(isinstance(x, (int, float)) for x in values)}
        for dim, values in axes.items():
            axis = Variable(dim, "float64", (dim,), values.shape, False, math.nan, False)
            docs[f"{at.index}/{dim}"] = array_doc(axis, values.shape, values.shape, None, own["arrays"].get(dim, {}), preset, level)
            _put(f"{root}/{at.index}/{dim}/c/0", press(values, preset, level))
    for name, doc in docs.items():
        inside = {n.partition("/")[2]: d for n, d in docs.items() if n.startswith(f"{name}/")}
        _put(f"{root}/{name}/zarr.json", json.dumps(doc | consolidated(inside) if doc["node_type"] == "group" else doc).encode())
    whole = {"zarr_format": 3, "node_type": "group", "attributes": pyramid.doc["attrs"]} | consolidated(docs)
    _put(f"{root}/zarr.json", json.dumps(whole).encode())


def consolidated(docs: dict[str, Any]) -> dict[str, Any]:
    return {"consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": docs}}


def export_arrays(cells: DataFrame, variables: list[Variable], layouts: dict[str, Any], dims: tuple[str, ...], unit: tuple[int, ...], extra: dict[str, list], root: str, preset: str, level: int) -> None:
    """The variables of a level that share dimensions and write unit, in one shuffle. A task holds one unit of each and fills it as rows stream by."""
    lead = dims[:-2]
    for d in lead:  # the place of a value along its dimension
        cells = cells.withColumn(f"_{d}", F.array_position(F.array(*map(F.lit, extra[d])), F.col(d).cast("string") if isinstance(extra[d][0], str) else F.col(d)).cast("int") - 1)
    places = [*(f"_{d}" for d in lead), "row", "col"]
    keys = [F.floor(F.col(p) / u).cast("int").alias(f"u{i}") for i, (p, u) in enumerate(zip(places, unit, strict=True))]
    units = [f"u{i}" for i in range(len(unit))]
    values = [(F.col(v.name).cast("string") if v.dtype == "uint64" else F.col(v.name)).alias(f"v{i}") for i, v in enumerate(variables)]
    rows = cells.select(*keys, *[(F.col(p) % u).cast("int").alias(f"p{i}") for i, (p, u) in enumerate(zip(places, unit, strict=True))], *values)
    rows = rows.repartition(*units).sortWithinPartitions(*units)

    def save(key: tuple[int, ...], blocks: list[np.ndarray]) -> int:
        total = 0
        for v, block in zip(variables, blocks, strict=True):
            if layouts[v.name].shards:
                data = encode_shard(block, layouts[v.name].chunks, v.fill, preset, level)
            else:
                data = None if is_fill(block, v.fill) else press(block, preset, level)
            if data:
                _put("/".join([root, v.name, "c", *map(str, key)]), data)
                total += len(data)
        return total

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, blocks, total = None, [], 0
        for batch in batches:
            at = np.stack([batch.column(u).to_numpy() for u in units], 1)
            edges = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), len(at)] if len(at) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if (key := tuple(at[a].tolist())) != held:
                    total += save(held, blocks) if held is not None else 0
                    held, blocks = key, [np.full(unit, v.fill, v.dtype) for v in variables]
                part = batch.slice(a, b - a)
                place = [part.column(f"p{i}").to_numpy() for i in range(len(unit))]
                for i, (v, block) in enumerate(zip(variables, blocks, strict=True)):
                    column = part.column(f"v{i}")
                    real = column.is_valid().to_numpy(zero_copy_only=False)
                    found = column.drop_null()
                    found = np.array(list(map(int, found.to_pylist())), np.uint64) if v.dtype == "uint64" else found.to_numpy(zero_copy_only=False)
                    block[tuple(p[real] for p in place)] = found.astype(v.dtype)
        total += save(held, blocks) if held is not None else 0
        yield pa.RecordBatch.from_pydict({"n": [total]})

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


@dataclass(frozen=True)
class Array:
    """A stored array: its document, and reading one write unit of it."""

    path: str
    doc: dict[str, Any]

    @classmethod
    def open(cls, path: str) -> Array:
        doc = json.loads(_get(f"{path}/zarr.json") or b"null")
        if doc is None:
            raise FileNotFoundError(path)
        out = cls(path, doc)
        if bad := [c for c in out.codecs if c not in ("bytes", "zstd", "blosc")]:
            raise ValueError(f"codecs that aren't supported: {bad}")
        return out

    @property
    def sharding(self) -> dict[str, Any] | None:
        return next((c["configuration"] for c in self.doc["codecs"] if c["name"] == "sharding_indexed"), None)

    @property
    def codecs(self) -> list[str]:
        return [c["name"] for c in (self.sharding or self.doc)["codecs"]]

    @property
    def unit(self) -> tuple[int, ...]:
        return tuple(self.doc["chunk_grid"]["configuration"]["chunk_shape"])

    @property
    def counts(self) -> tuple[int, ...]:
        return tuple(-(-n // u) for n, u in zip(self.doc["shape"], self.unit, strict=True))

    @property
    def dims(self) -> list[str]:
        return self.doc.get("dimension_names") or [f"d{i}" for i in range(len(self.unit))]

    @property
    def fill(self) -> Any:
        return math.nan if self.doc["fill_value"] == "NaN" else self.doc["fill_value"]

    def schema(self, name: str) -> T.StructType:
        return T.StructType([*(T.StructField(d, T.LongType()) for d in self.dims), T.StructField(name, SPARK_TYPES[self.doc["data_type"]])])

    def block(self, n: int) -> np.ndarray | None:
        """The n-th write unit, cut to the array; nothing if it isn't stored."""
        at, dtype = [int(i) for i in np.unravel_index(n, self.counts)], self.doc["data_type"]
        if (data := _get("/".join([self.path, "c", *map(str, at)]))) is None:
            return None
        codec = "blosc" if "blosc" in self.codecs else "zstd"
        if self.sharding:
            found = decode_shard(data, self.unit, tuple(self.sharding["chunk_shape"]), dtype, self.fill, codec)
        else:
            found = np.frombuffer(unpress(data, codec, math.prod(self.unit) * np.dtype(dtype).itemsize), dtype).reshape(self.unit)
        return found[tuple(slice(0, min(u, s - i * u)) for i, u, s in zip(at, self.unit, self.doc["shape"], strict=True))]

    def real(self, block: np.ndarray) -> np.ndarray:
        """Which values aren't fill."""
        return ~np.isnan(block) if isinstance(self.fill, float) and math.isnan(self.fill) else block != self.fill

    def column(self, values: np.ndarray, real: np.ndarray) -> pa.Array:
        if self.doc["data_type"] == "uint64":
            return pa.array([Decimal(int(x)) if r else None for x, r in zip(values, real, strict=True)], pa.decimal128(20, 0))
        kind = {"float16": np.float32, "uint8": np.int16, "uint16": np.int32, "uint32": np.int64}.get(self.doc["data_type"])
        return pa.array(values if kind is None else values.astype(kind), mask=~real)


def cells_of(arrays: dict[str, Array], n: int, rows: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The cells of the n-th write unit of arrays that have the same units: places, and every array's value or null."""
    first = next(iter(arrays.values()))
    blocks = {name: found for name, a in arrays.items() if (found := a.block(n)) is not None}
    if not blocks:
        return
    real = {name: arrays[name].real(b) for name, b in blocks.items()}
    where = np.nonzero(np.logical_or.reduce(list(real.values())))
    at = np.unravel_index(n, first.counts)
    for k in range(0, len(where[0]), rows):
        part = tuple(w[k : k + rows] for w in where)
        columns = [pa.array(w.astype(np.int64) + int(i) * u) for w, i, u in zip(part, at, first.unit, strict=True)]
        for name, a in arrays.items():
            columns.append(a.column(blocks[name][part], real[name][part]) if name in blocks else a.column(np.zeros(len(part[0]), a.doc["data_type"]), np.zeros(len(part[0]), bool)))
        yield pa.RecordBatch.from_arrays(columns, names=[*first.dims, *arrays])


def read_arrays(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The cells of arrays (paths by column) that have the same dimensions, shape and write unit: a task reads the unit of all of them, nothing is joined."""
    arrays = {name: Array.open(path) for name, path in paths.items()}
    first, n = next(iter(arrays.values())), math.prod(next(iter(arrays.values())).counts)
    schema = T.StructType([*first.schema("_").fields[:-1], *(a.schema(name).fields[-1] for name, a in arrays.items())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from cells_of(arrays, k)

    return spark.range(0, n, 1, n).mapInArrow(read, schema)


def read_array(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """An array's cells: one row for every value that isn't fill; columns are the dimensions' places and ``name``."""
    return read_arrays(spark, {name: path})


class ZarrSource(DataSource):
    """``spark.read.format("zarr").load(path)``: an array's cells; a partition is a write unit. Register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _open(self) -> tuple[Array, str]:
        return Array.open(self.options["path"].rstrip("/")), self.options.get("column", "value")

    def schema(self) -> T.StructType:
        array, name = self._open()
        return array.schema(name)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZarrReader(*self._open())


class ZarrReader(DataSourceReader):
    def __init__(self, array: Array, name: str):
        self.array, self.name = array, name

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(math.prod(self.array.counts))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from cells_of({self.name: self.array}, partition.value)


def open_raster(spark: SparkSession, path: str, variables: list[str] | None = None) -> Raster:
    """A group's arrays that share dimensions, joined by cell, as a raster with its coordinates' values."""
    root = json.loads(_get(f"{path.rstrip('/')}/zarr.json") or b"null")
    if root is None:
        raise FileNotFoundError(path)
    system, at = _fs(path)
    from pyarrow import fs

    arrays = {}
    for f in system.get_file_info(fs.FileSelector(at)):
        if f.type != fs.FileType.Directory:
            continue
        doc = json.loads(_get(f"{path}/{f.base_name}/zarr.json") or b"null")
        if doc and doc["node_type"] == "array":
            arrays[f.base_name] = doc
    axes = {n for n, d in arrays.items() if d.get("dimension_names") == [n]}
    data = {n: d for n, d in arrays.items() if len(d["shape"]) >= 2}
    if variables is not None:
        if bad := [n for n in variables if n not in data]:
            raise ValueError(f"unknown variables {bad}; there are {sorted(data)}")
        data = {n: data[n] for n in variables}
    dims = max((d["dimension_names"] for d in data.values()), key=len)
    out, alike = None, {}
    for n, d in data.items():
        alike.setdefault(json.dumps([d["dimension_names"], d["shape"], d["chunk_grid"]]), []).append(n)
    for names in alike.values():
        one = read_arrays(spark, {n: f"{path}/{n}" for n in names})
        out = one if out is None else out.join(one, [d for d in dims if d in one.columns and d in out.columns], "full")
    for d in dims:
        if d in axes:
            labels = read_array(spark, f"{path}/{d}", "_value").withColumnRenamed(d, "_place")
            out = out.withColumnRenamed(d, "_place").join(labels, "_place").drop("_place").withColumnRenamed("_value", d)
    attrs = {n: dict(d["attributes"]) | {"dtype": d["data_type"], "encoding": {"fill_value": None if d["fill_value"] == "NaN" else d["fill_value"]}} for n, d in data.items()}
    return Raster(out, tuple(dims), attrs, {d: arrays[d]["attributes"] for d in dims if d in axes}, root.get("attributes", {}), {n: d["attributes"] for n, d in arrays.items() if not d["shape"]})
