"""NetCDF files of the classic formats (1, 2 and 5) as rasters. The driver reads the header, tasks read slabs by their byte ranges."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from ..grid import GridError, Raster
from .zarr import SPARK_TYPES, _fs

#: The format's types by number.
KINDS = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass(frozen=True)
class Held:
    """A variable of a file: its dimensions, attributes, type and where its values are. ``step`` is the distance between records."""

    name: str
    dims: tuple[str, ...]
    attrs: dict[str, Any]
    kind: np.dtype
    begin: int
    step: int | None


class Header:
    """A file's dimensions, attributes and variables."""

    def __init__(self, path: str):
        system, at = _fs(path)
        with system.open_input_file(at) as self.file:
            magic = self.file.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} isn't a classic NetCDF file" + (" (HDF5 files aren't read)" if magic[1:] == b"HDF" else ""))
            self.wide, self.far = magic[3] == 5, magic[3] != 1
            self.path, records = path, self._number()
            self.sizes, dims = {}, []
            for _ in range(self._list()):
                dims.append(self._text())
                self.sizes[dims[-1]] = self._number()
            unlimited = next((d for d, n in self.sizes.items() if n == 0), None)
            self.attrs, self.variables = self._attributes(), {}
            found = []
            for _ in range(self._list()):
                name = self._text()
                own = tuple(dims[self._number()] for _ in range(self._number()))
                attrs, kind, _ = self._attributes(), np.dtype(KINDS[self._int()]), self._number()
                found.append((name, own, attrs, kind, struct.unpack(">q" if self.far else ">i", self.file.read(8 if self.far else 4))[0]))
        of = lambda own, kind: math.prod(self.sizes[d] for d in own[1:]) * kind.itemsize
        kept = [of(own, kind) for _, own, _, kind, _ in found if own and own[0] == unlimited]
        record = kept[0] if len(kept) == 1 else sum(math.ceil(n / 4) * 4 for n in kept)
        if unlimited:
            self.sizes[unlimited] = records
        for name, own, attrs, kind, begin in found:
            self.variables[name] = Held(name, own, attrs, kind, begin, record if own and own[0] == unlimited else None)

    def _int(self) -> int:
        return struct.unpack(">i", self.file.read(4))[0]

    def _number(self) -> int:
        return struct.unpack(">q", self.file.read(8))[0] if self.wide else self._int()

    def _list(self) -> int:
        self._int()
        return self._number()

    def _padded(self, n: int) -> bytes:
        return self.file.read(math.ceil(n / 4) * 4)[:n]

    def _text(self) -> str:
        return self._padded(self._number()).decode()

    def _attributes(self) -> dict[str, Any]:
        out = {}
        for _ in range(self._list()):
            name, kind = self._text(), np.dtype(KINDS[self._int()])
            n = self._number()
            raw = self._padded(n * kind.itemsize)
            out[name] = raw.decode().rstrip("\0") if kind.kind == "S" else (v := np.frombuffer(raw, kind).tolist())[0] if n == 1 else v
        return out

    def read(self, v: Held, first: int = 0, count: int | None = None) -> np.ndarray:
        """Some indices along the first dimension of a variable, all of the others."""
        shape = [self.sizes[d] for d in v.dims]
        count = (shape[0] if count is None else count) if shape else 1
        inner = math.prod(shape[1:])
        size, step = inner * v.kind.itemsize, v.step or inner * v.kind.itemsize
        system, at = _fs(self.path)
        with system.open_input_file(at) as f:
            f.seek(v.begin + first * step)
            raw = f.read((count - 1) * step + size if count else 0)
        lines = [np.frombuffer(raw, v.kind, inner, k * step) for k in range(count)] if v.step else [np.frombuffer(raw, v.kind, count * inner)]
        return np.concatenate(lines).reshape(count, *shape[1:]) if shape else lines[0].reshape(())

    def __getstate__(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "file"}


def open_netcdf(spark: SparkSession, path: str, variables: list[str] | None = None, slab: int = 1 << 22) -> Raster:
    """The variables of a file that share the most dimensions, as a raster with their coordinates; tasks read about ``slab`` values each."""
    head = Header(path)
    names = [n for n, v in head.variables.items() if len(v.dims) >= 2 and v.kind.kind != "S"]
    if bad := [n for n in variables or () if n not in names]:
        raise ValueError(f"unknown variables {bad}; there are {names}")
    names = list(variables or names)
    if not names:
        raise GridError(f"{path} has no variable of two dimensions")
    dims = max((head.variables[n].dims for n in names), key=len)
    same = [n for n in names if head.variables[n].dims == dims]
    if left := [n for n in names if n not in same]:
        raise GridError(f"variables {left} have other dimensions than {same}; choose some")
    coords = {d: head.variables[d] for d in dims if d in head.variables and head.variables[d].dims == (d,)}
    axes = {d: head.read(coords[d]).astype(coords[d].kind.newbyteorder("=")) if d in coords else np.arange(head.sizes[d]) for d in dims}
    shape = tuple(head.sizes[d] for d in dims)
    rows = max(1, slab // max(1, math.prod(shape[1:])))
    n = math.ceil(shape[0] / rows)
    plain = {"uint8": np.int16, "uint16": np.int32, "uint32": np.int64}
    own = {m: head.variables[m].kind.newbyteorder("=").name for m in same}
    held = {m: head.variables[m] for m in same}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                first = k * rows
                blocks = {m: head.read(v, first, min(rows, shape[0] - first)) for m, v in held.items()}
                size = next(iter(blocks.values())).shape
                for a in range(0, math.prod(size), 1 << 18):
                    at = np.unravel_index(np.arange(a, min(math.prod(size), a + (1 << 18))), size)
                    columns = [pa.array(axes[d][i + (first if j == 0 else 0)]) for j, (d, i) in enumerate(zip(dims, at, strict=True))]
                    columns += [pa.array(blocks[m][at].astype(plain.get(own[m], own[m]))) for m in same]
                    yield pa.RecordBatch.from_arrays(columns, names=[*dims, *same])

    fields = [T.StructField(d, SPARK_TYPES[axes[d].dtype.name]) for d in dims] + [T.StructField(m, SPARK_TYPES[own[m]]) for m in same]
    attrs = {m: dict(held[m].attrs) | {"dtype": own[m]} for m in same}
    scalars = {m: v.attrs for m, v in head.variables.items() if not v.dims}
    return Raster(spark.range(0, n, 1, n).mapInArrow(run, T.StructType(fields)), dims, attrs, {d: v.attrs for d, v in coords.items()}, head.attrs, scalars, axes={d: np.sort(a) for d, a in axes.items()})
