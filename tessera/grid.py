"""Grids: what a raster's variables share, and finding it out from labelled columns.

A raster comes as a DataFrame of one row a cell: a column for every dimension's coordinate and one for every variable.
It leaves as *cells*: the extra dimensions, ``row`` (0 is the northernmost), ``col`` (0 is the westernmost) and the
variables, nulls for missing data.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crs as crs_registry

log = logging.getLogger("tessera")


class GridError(ValueError):
    """A raster whose grid can't be found out, or that isn't regular."""


@dataclass(frozen=True)
class Variable:
    name: str
    dtype: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    categorical: bool
    fill: Any
    declared: bool

    @property
    def kind(self) -> str:
        return np.dtype(self.dtype).kind

    @property
    def itemsize(self) -> int:
        return np.dtype(self.dtype).itemsize


@dataclass(frozen=True)
class Grid:
    x: str
    y: str
    crs: crs_registry.Crs
    shape: tuple[int, int]
    transform: tuple[float, float, float, float, float, float]
    variables: tuple[Variable, ...]
    extra: tuple[str, ...]

    @property
    def bbox(self) -> tuple[float, float, float, float]:
        return bounds(self.transform, self.shape)

    def variable(self, name: str) -> Variable:
        return next(v for v in self.variables if v.name == name)


def bounds(transform: tuple[float, ...], shape: tuple[int, int]) -> tuple[float, float, float, float]:
    """West, south, east, north of a north-up grid."""
    a, _, c, _, e, f = transform
    return c, f + e * shape[0], c + a * shape[1], f


@dataclass
class Raster:
    """A labelled raster. ``variables``: attributes by name, ``dtype`` the array's own type; ``coords``: attributes by dimension.

    ``scalars`` names variables that lack a spatial dimension, with their attributes (grid mappings are among them).
    """

    df: DataFrame
    dims: tuple[str, ...]
    variables: Mapping[str, Mapping[str, Any]]
    coords: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    attrs: Mapping[str, Any] = field(default_factory=dict)
    scalars: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)
    #: Dimensions whose coordinate is in a column of another name.
    named: Mapping[str, str] = field(default_factory=dict)
    #: Sorted values of dimensions that are known without reading the cells.
    axes: Mapping[str, np.ndarray] = field(default_factory=dict)

    def plan(self, *, crs: Any = None, fill_values: Mapping[str, Any] | None = None, **options: Any) -> Any:
        """The pyramid that ``to_pyramid`` would write, without writing it."""
        from .plans.levels import build_plan

        return build_plan(detect(self, crs, fill_values).grid, **options)

    def to_pyramid(self, path: str, **options: Any) -> Any:
        from .store import to_pyramid

        return to_pyramid(self, path, **options)


#: The names spatial dimensions go by, in order of preference, and the standard names of their coordinates.
NAMES = (("x", "y"), ("lon", "lat"), ("longitude", "latitude"))
STANDARD = (("projection_x_coordinate", "projection_y_coordinate"), ("longitude", "latitude"), ("grid_longitude", "grid_latitude"))


def spatial_dims(raster: Raster) -> tuple[str, str]:
    """The x and the y dimension: by name, by the CF ``axis``, by standard name."""
    known = list(dict.fromkeys([*raster.dims, *raster.coords]))
    for pair in NAMES:
        if all(n in known for n in pair):
            return pair
    axis = {a: [d for d in known if str(raster.coords.get(d, {}).get("axis", "")).upper() == a] for a in "XY"}
    if all(len(v) == 1 for v in axis.values()):
        return axis["X"][0], axis["Y"][0]
    standard = {raster.coords.get(d, {}).get("standard_name"): d for d in known}
    for pair in STANDARD:
        if all(n in standard for n in pair):
            return standard[pair[0]], standard[pair[1]]
    raise GridError(f"no spatial dimensions found among {known}")


def grid_step(values: np.ndarray) -> float:
    """The slope of the values against their number, by least squares."""
    v = np.asarray(values, np.float64)
    if len(v) == 2:
        return float(v[1] - v[0])
    i = np.arange(len(v)) - (len(v) - 1) / 2
    return float((i * (v - v.mean())).sum() / (i * i).sum())


def check_regular(name: str, values: np.ndarray, step: float) -> float:
    """How far the values are from a regular axis at most; raises if that is too far."""
    if step == 0:
        raise GridError(f"coordinate {name!r} doesn't change")
    v = np.asarray(values, np.float64)
    eps = np.finfo(values.dtype).eps if values.dtype.kind == "f" else 0.0
    allowed = max(1e-6 * abs(step), 8 * eps * np.abs(v).max())
    off = np.abs(v - (v[0] + step * np.arange(len(v)))).max()
    if off > allowed:
        raise GridError(f"coordinate {name!r} isn't regular: off by {off:g} where {allowed:g} is allowed")
    return float(off)


def single_step(raster: Raster, dim: str) -> float:
    """The step of an axis of one pixel: the attribute ``res`` of its coordinate or of the raster, which may be a pair (x, y)."""
    for attrs in (raster.coords.get(dim, {}), raster.attrs):
        if (res := attrs.get("res")) is not None:
            pair = list(res) if isinstance(res, (list, tuple, np.ndarray)) else [res, res]
            return abs(float(pair[0 if dim == spatial_dims(raster)[0] else -1]))
    raise GridError(f"dimension {dim!r} has one pixel; give its size as attribute 'res'")


def dtype_range(dtype: str) -> tuple[int, int]:
    if np.dtype(dtype).kind not in "iu":
        raise ValueError(f"a variable of type {dtype} has no integer range")
    info = np.iinfo(dtype)
    return int(info.min), int(info.max)


def sentinel(dtype: str, flags: list | None = None) -> int:
    """The value that stands for missing integers: the type's minimum if signed, else its maximum, unless a flag has it."""
    low, high = dtype_range(dtype)
    order = [low, high] if np.dtype(dtype).kind == "i" else [high, low]
    free = [v for v in order if v not in {int(f) for f in (flags if flags is not None else [])}]
    if not free:
        raise GridError(f"both ends of {dtype} are flag values; declare a fill value")
    return free[0]


def check_fill(name: str, dtype: str, value: Any) -> Any:
    """A fill value that the caller gives for a variable, in the variable's type."""
    kind = np.dtype(dtype).kind
    number = isinstance(value, (int, float, np.integer, np.floating)) and not isinstance(value, (bool, np.bool_))
    if kind == "b":
        raise ValueError(f"{name!r} is boolean and takes no fill value")
    if not number:
        raise ValueError(f"the fill value of {name!r} isn't a number: {value!r}")
    if kind in "iu":
        low, high = dtype_range(dtype)
        if not math.isfinite(value) or value != int(value) or not low <= value <= high:
            raise ValueError(f"the fill value of {name!r} isn't a whole number of type {dtype}: {value!r}")
        return int(value)
    return float(value)


def declared_fill(name: str, attrs: Mapping[str, Any], dtype: str, given: Mapping[str, Any] | None = None) -> tuple[Any, bool]:
    """The fill value a variable declares and whether it does.

    In order: the caller's; ``_FillValue`` then ``missing_value`` among the attributes, then in the encoding; ``nodata``;
    a store's own ``fill_value`` unless it is zero.
    """
    if given and name in given:
        return check_fill(name, dtype, given[name]), True
    encoding = attrs.get("encoding") or {}
    for place in (attrs, encoding):
        for key in ("_FillValue", "missing_value"):
            if place.get(key) is not None:
                return np.asarray(place[key]).reshape(-1)[0].item(), True
    if attrs.get("nodata") is not None:
        return attrs["nodata"], True
    own = encoding.get("fill_value")
    return (own, True) if own else (None, False)


def effective_fill(dtype: str, declared: Any, flags: list | None = None) -> Any:
    """What stands for missing data on disk."""
    kind = np.dtype(dtype).kind
    if kind == "f":
        return math.nan
    if kind == "b":
        return False
    return int(declared) if declared is not None else sentinel(dtype, flags)


def is_lonlat(raster: Raster, x: str, y: str, xs: np.ndarray, ys: np.ndarray) -> bool:
    names = x in ("lon", "longitude") and y in ("lat", "latitude")
    units = [str(raster.coords.get(d, {}).get("units", "")) for d in (x, y)]
    standard = [str(raster.coords.get(d, {}).get("standard_name", "")) for d in (x, y)]
    rotated = any(s.startswith("grid_") for s in standard)
    names |= standard == ["longitude", "latitude"]
    degrees = all(u.lower().startswith("degree") for u in units)
    inside = xs.min() >= -180 and xs.max() <= 360 and ys.min() >= -90 and ys.max() <= 90
    return (names or degrees) and not rotated and bool(inside)


def find_crs(raster: Raster, given: Any, x: str, y: str, xs: np.ndarray, ys: np.ndarray) -> crs_registry.Crs:
    """The caller's CRS, else one the raster declares, else one its grid mapping describes, else longitude and latitude by name or unit."""
    if given is not None:
        return crs_registry.parse(given)
    if raster.attrs.get("crs") is not None:
        return crs_registry.parse(raster.attrs["crs"])
    for name in dict.fromkeys([str(a["grid_mapping"]).partition(":")[0] for a in raster.variables.values() if a.get("grid_mapping")] + ["spatial_ref"]):
        if (attrs := raster.scalars.get(name)) and (found := crs_registry.from_mapping(attrs)):
            return found
    if is_lonlat(raster, x, y, xs, ys):
        log.warning("no CRS is declared; %s and %s look like longitude and latitude: EPSG:4326", x, y)
        return crs_registry.parse("EPSG:4326")
    raise GridError("no CRS found; give one as crs=")


@dataclass(frozen=True)
class Wrap:
    """How longitudes above 180 move: ``split`` columns come behind the others; ``width`` columns once holes are filled."""

    split: int
    first: float
    width: int
    places: tuple[int, ...]


def wrap_longitude(xs: np.ndarray, dx: float) -> Wrap | None:
    """Longitudes from 0 to 360 become -180 to 180; a region over the antimeridian gets the columns in between."""
    if xs.max() <= 180:
        return None
    split = int(np.searchsorted(xs, 180, "right")) if xs.min() < 180 else 0
    moved = np.concatenate([xs[split:] - 360, xs[:split]]) if split else xs - 360
    place = (moved - moved[0]) / dx
    snapped = np.rint(place)
    if np.abs(place - snapped).max() > 1e-3:
        raise GridError("longitudes aren't on one grid once they are wrapped at 180 degrees")
    if int(snapped[-1]) + 1 > len(xs):
        log.warning("the region crosses the antimeridian: %d columns of missing data are put in", int(snapped[-1]) + 1 - len(xs))
    return Wrap(split, float(moved[0]), int(snapped[-1]) + 1, tuple(int(i) for i in snapped))


@dataclass(frozen=True)
class Found:
    """What ``detect`` returns: ``cells`` is lazy; ``xs`` and ``ys`` are the pixel centres of level 0."""

    cells: DataFrame
    grid: Grid
    xs: np.ndarray
    ys: np.ndarray
    extra: dict[str, list]


def axis_values(df: DataFrame, column: str) -> np.ndarray:
    """The distinct values of an axis, sorted. An axis is as long as an edge of the grid, not as its area."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).toPandas()[column].to_numpy()
    return rows


def detect(raster: Raster, crs: Any = None, fill_values: Mapping[str, Any] | None = None, sizes: Mapping[str, tuple[str, ...]] | None = None) -> Found:
    """Finds the grid of a raster and its cells in canonical order. Variables are never computed, axes are read."""
    x, y = spatial_dims(raster)
    column = lambda d: raster.named.get(d, d)
    for d in (x, y):
        if d not in raster.dims or isinstance(raster.coords.get(d, {}).get("dims"), (list, tuple)) and len(raster.coords[d]["dims"]) != 1:
            raise GridError(f"coordinate {d!r} isn't one-dimensional: curvilinear grids aren't supported")
    over = sizes or {}
    kept = {n: a for n, a in raster.variables.items() if {x, y} <= set(over.get(n, raster.dims))}
    for n in raster.variables:
        if n not in kept:
            log.warning("variable %r lacks a spatial dimension and is left out", n)
    if not kept:
        raise GridError("no variable has both spatial dimensions")
    if unknown := [n for n in fill_values or {} if n not in kept]:
        raise ValueError(f"fill_values has unknown variables {unknown}; there are {sorted(kept)}")
    along = lambda d: np.asarray(raster.axes[d]) if d in raster.axes else axis_values(raster.df, column(d))
    xs, ys = along(x), along(y)
    if not len(xs) or not len(ys):
        raise GridError("the raster has no cells")
    if raster.coords.get(x, {}).get("order") == "descending":
        raise GridError(f"{x!r} descends")
    dx = grid_step(xs) if len(xs) > 1 else single_step(raster, x)
    dy = grid_step(ys) if len(ys) > 1 else single_step(raster, y)
    check_regular(x, xs, dx)
    check_regular(y, ys, dy)
    found_crs = find_crs(raster, crs, x, y, xs, ys)
    row = (F.lit(len(ys) - 1) - F.rint((F.col(column(y)) - F.lit(float(ys[0]))) / F.lit(dy))).cast("int")
    place = F.rint((F.col(column(x)) - F.lit(float(xs[0]))) / F.lit(dx)).cast("int")
    first, nx, col, centres = float(xs[0]), len(xs), place, np.asarray(xs, np.float64)
    if found_crs.geographic and (wrap := wrap_longitude(centres, dx)):
        first, nx = wrap.first, wrap.width
        tail = len(xs) - wrap.split
        # columns behind the split come first; the others follow at their snapped places
        col = F.when(place >= wrap.split, place - wrap.split).otherwise(place + (wrap.places[tail] if wrap.split else 0))
        centres = wrap.first + dx * np.arange(nx)
    extra = tuple(d for d in raster.dims if d not in (x, y))
    labels = {d: along(d).tolist() for d in extra}
    variables, columns = [], []
    for n, attrs in kept.items():
        dtype = str(attrs.get("dtype") or {"float": "float32", "double": "float64", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "boolean": "bool"}[dict(raster.df.dtypes)[n]])
        kind = np.dtype(dtype).kind
        if kind not in "fiub":
            raise ValueError(f"variable {n!r} is of type {dtype}; only numbers and booleans are supported")
        flags = attrs.get("flag_values")
        declared, is_declared = declared_fill(n, attrs, dtype, fill_values) if kind != "b" else (None, False)
        if kind == "b" and fill_values and n in fill_values:
            check_fill(n, dtype, fill_values[n])
        fill = effective_fill(dtype, declared, flags)
        value = F.col(n)
        if kind == "f":
            value = F.when(~F.isnan(value), value)
            if declared is not None and not math.isnan(float(declared)):
                value = F.when(value != F.lit(float(declared)).cast(dict(raster.df.dtypes)[n]), value)
        elif kind in "iu":
            value = F.when(value != F.lit(fill), value)
        columns.append(value.alias(n))
        dims = (*[d for d in extra if d in over.get(n, raster.dims)], y, x)
        shape = (*[len(labels[d]) for d in dims[:-2]], len(ys), nx)
        variables.append(Variable(n, dtype, dims, shape, kind in "iub" or "flag_values" in attrs or "flag_meanings" in attrs, fill, is_declared))
    transform = (dx, 0.0, first - dx / 2, 0.0, -abs(dy), float(ys[-1]) + abs(dy) / 2)
    cells = raster.df.select(*[F.col(column(d)).alias(d) for d in extra], row.alias("row"), col.alias("col"), *columns)
    return Found(cells, Grid(x, y, found_crs, (len(ys), nx), transform, tuple(variables), extra), centres, np.asarray(ys, np.float64)[::-1], labels)
