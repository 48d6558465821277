"""Pyramids on disk: one Parquet folder a level, and a catalog beside them. Works on every file system that Spark reads."""

from __future__ import annotations

import json
import logging
import re
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metadata
from .crs import parse
from .grid import Found, Grid, Raster, Variable, detect
from .operators.blocks import halve
from .operators.quantize import quantize
from .plans.chunks import Layout
from .plans.levels import Level, Plan, build_plan

log = logging.getLogger("tessera")
MARKER = "_pyramid.json"


class Files:
    """The few file operations that pyramids need, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def group_path(path: str, group: str | None) -> str:
    """The folder of a sub-group, whose name has no empty or dotted parts."""
    if group is None or not group.strip("/"):
        return path.rstrip("/")
    parts = group.strip("/").split("/")
    if any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"not a group: {group!r}")
    return "/".join([path.rstrip("/"), *parts])


@dataclass(frozen=True)
class Result:
    path: str
    plan: Plan
    validation: dict[str, list[str]]
    timings: dict[str, float] = field(default_factory=dict)


def write_level(cells: DataFrame, plan: Plan, level: int, path: str) -> None:
    """One level, clustered by the blocks that a task writes and sorted within them, so that windows prune row groups."""
    unit = max((lay.unit[-2:] for lay in plan.levels[level].layouts.values()), key=lambda u: u[0] * u[1])
    by = [*plan.grid.extra, F.floor(F.col("row") / unit[0]), F.floor(F.col("col") / unit[1])]
    cells.repartition(*by).sortWithinPartitions(*plan.grid.extra, "row", "col").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/level={level}")


def check_written(spark: SparkSession, plan: Plan, level: int, path: str) -> None:
    """Raises if a level as it was stored has other columns than planned, cells outside its shape or not one cell where it should have some."""
    cells, (ny, nx) = spark.read.parquet(f"{path}/level={level}"), plan.levels[level].shape
    want = {*plan.grid.extra, "row", "col", *(v.name for v in plan.grid.variables)}
    if set(cells.columns) != want:
        raise OSError(f"level {level} was stored with columns {sorted(cells.columns)}; {sorted(want)} were planned")
    ends = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if ends[0] is not None and not (0 <= ends[0] and ends[1] < ny and 0 <= ends[2] and ends[3] < nx):
        raise OSError(f"level {level} was stored with cells outside its shape {ny}×{nx}")


def connect(spark: SparkSession, options: Mapping[str, Any]) -> None:
    """Makes an object store's options those of the session's file systems."""
    from .viewer import object_store_settings

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, v in object_store_settings(options).items():
        conf.set(k, v)


def to_pyramid(raster: Raster | Found, path: str, *, group: str | None = None, crs: Any = None, fill_values: Mapping[str, Any] | None = None, resampling: Any = "auto", tile_size: Any = 512, max_levels: int | None = None, shard_size: Any = None, keepbits: Any = None, overwrite: bool = False, validate: bool = True, encoding_preset: str | None = None, compression_level: int = 3, preview: str | None = None, storage_options: Mapping[str, Any] | None = None) -> Result:
    """Detects, plans and writes every level: each from the one before as it was stored, which also cuts the lineage.

    ``encoding_preset`` (``web`` or ``zstd``, at ``compression_level``) also writes the pyramid as Zarr, into its folder ``zarr``;
    ``preview`` is where a page with its configuration goes; ``storage_options`` are an object store's (``endpoint``, ``region``,
    ``key``, ``secret``, ``token``, ``anonymous``).
    """
    if not isinstance(path, str):
        raise TypeError(f"a place is a text, not {type(path).__name__}")
    if encoding_preset is not None:
        from .sources.zarr import check_preset

        check_preset(encoding_preset, compression_level)
    if storage_options is not None:
        connect((raster.cells if isinstance(raster, Found) else raster.df).sparkSession, storage_options)
    found = raster if isinstance(raster, Found) else detect(raster, crs, fill_values)
    plan = build_plan(found.grid, resampling, tile_size, max_levels, shard_size, keepbits)
    spark, here = found.cells.sparkSession, group_path(path, group)
    files = Files(spark)
    if names := files.names(here):
        if MARKER not in names:
            raise FileExistsError(f"{here} holds other things than a pyramid; it isn't replaced")
        if not overwrite:
            raise FileExistsError(f"{here} holds a pyramid; overwrite=True replaces it")
        for n in names:
            if n in (MARKER, "zarr") or n.startswith("level="):
                files.delete(f"{here}/{n}")
    dtypes, timings, began = {v.name: v.dtype for v in found.grid.variables}, {}, time.time()
    chosen = [(v, plan.methods[v.name]) for v in found.grid.variables]
    for k in range(len(plan.levels)):
        at = time.time()
        cells = found.cells if k == 0 else halve(spark.read.parquet(f"{here}/level={k - 1}"), chosen, found.grid.extra)
        write_level(quantize(cells, plan.keepbits, dtypes), plan, k, here)
        check_written(spark, plan, k, here)
        timings[f"level_{k}"] = time.time() - at
    source = raster.attrs if isinstance(raster, Raster) else {}
    files.write(f"{here}/{MARKER}", json.dumps(describe(found, plan, source, raster if isinstance(raster, Raster) else None)))
    from .validate import is_valid
    from .validate import validate as check

    report = check(spark, path, group=group, plan=plan) if validate else {}
    if validate and not is_valid(report):
        log.warning("the pyramid at %s isn't valid: %s", here, report)
    if encoding_preset is not None:
        from .sources.zarr import export

        at = time.time()
        export(open_pyramid(spark, path, group), f"{here}/zarr", encoding_preset, compression_level)
        timings["zarr"] = time.time() - at
    if preview is not None:
        from .viewer import page, store_name

        files.write(preview, page(read_config(spark, path, group), store_name(here)))
    timings["total"] = time.time() - began
    return Result(here, plan, report, timings)


def _json(value: Any) -> Any:
    return None if isinstance(value, float) and value != value else value


def describe(found: Found, plan: Plan, source: Mapping[str, Any], raster: Raster | None) -> dict[str, Any]:
    """All of a pyramid's metadata in one document."""
    g = found.grid
    return {
        "attrs": metadata.root_attrs(plan, source),
        "levels": {str(v.index): {"attrs": metadata.level_attrs(plan, v.index), "arrays": metadata.cf_attrs(plan, v.index), "layouts": {n: {"chunks": lay.chunks, "shards": lay.shards, "shape": v.shapes[n]} for n, lay in v.layouts.items()}} for v in plan.levels},
        "grid": {"x": g.x, "y": g.y, "crs": g.crs.code or g.crs.wkt, "shape": g.shape, "transform": g.transform, "extra": {d: [str(v) if not isinstance(v, (int, float)) else v for v in found.extra[d]] for d in g.extra}},
        "variables": [{"name": v.name, "dtype": v.dtype, "dims": v.dims, "shape": v.shape, "categorical": v.categorical, "fill": _json(v.fill), "declared": v.declared, "method": plan.methods[v.name], "keepbits": plan.keepbits.get(v.name), "tile": plan.tiles[v.name], "attrs": metadata.jsonable({k: x for k, x in (raster.variables[v.name] if raster else {}).items() if k not in ("encoding", "dtype", "_FillValue", "missing_value")})} for v in g.variables],
    }


@dataclass(frozen=True)
class Pyramid:
    """A stored pyramid."""

    spark: SparkSession
    path: str
    doc: dict[str, Any]

    @property
    def n_levels(self) -> int:
        return len(self.doc["levels"])

    def level(self, k: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level={k}")

    def levels(self) -> DataFrame:
        """All levels, told apart by the partition column ``level``."""
        return self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/level={k}" for k in range(self.n_levels)))

    @property
    def plan(self) -> Plan:
        g = self.doc["grid"]
        variables = tuple(Variable(v["name"], v["dtype"], tuple(v["dims"]), tuple(v["shape"]), v["categorical"], float("nan") if v["fill"] is None else v["fill"], v["declared"]) for v in self.doc["variables"])
        grid = Grid(g["x"], g["y"], parse(g["crs"]), tuple(g["shape"]), tuple(g["transform"]), variables, tuple(g["extra"]))
        size = {v.name: v.itemsize for v in variables}
        levels = []
        for k, v in self.doc["levels"].items():
            layouts = {n: Layout(tuple(x["chunks"]), tuple(x["shards"]) if x["shards"] else None, size[n]) for n, x in v["layouts"].items()}
            levels.append(Level(int(k), tuple(v["attrs"]["spatial:shape"]), tuple(v["attrs"]["spatial:transform"]), layouts, {n: tuple(x["shape"]) for n, x in v["layouts"].items()}))
        own = {v["name"]: v for v in self.doc["variables"]}
        return Plan(grid, {n: v["method"] for n, v in own.items()}, tuple(levels), {n: v["tile"] for n, v in own.items()}, {n: v["keepbits"] for n, v in own.items() if v["keepbits"] is not None})


def open_pyramid(spark: SparkSession, path: str, group: str | None = None) -> Pyramid:
    here = group_path(path, group)
    files = Files(spark)
    if not files.exists(f"{here}/{MARKER}"):
        raise FileNotFoundError(f"no pyramid at {here}")
    return Pyramid(spark, here, json.loads(files.read(f"{here}/{MARKER}")))


def read_config(spark: SparkSession, path: str, group: str | None = None) -> dict[str, Any]:
    """What a viewer needs to begin: the layout, and statistics of the coarsest level's first slice for each variable."""
    from .functions import display
    from .operators import stats

    p = open_pyramid(spark, path, group)
    attrs, own = p.doc["attrs"], {v["name"]: v for v in p.doc["variables"]}
    layout = (attrs.get("multiscales") or {}).get("layout")
    if not layout or not own:
        raise ValueError(f"{p.path} has no layout or no variable")
    order = [n for n in attrs.get(metadata.VARIABLES, []) if n in own]
    coarse, extra, out = p.level(p.n_levels - 1), p.doc["grid"]["extra"], []
    for d, values in extra.items():
        coarse = coarse.where(F.col(d).cast("string") == str(values[0])) if values else coarse
    for n in [*order, *sorted(set(own) - set(order))]:
        v, has = own[n], own[n]["attrs"]
        item = {"name": n, "dims": v["dims"], "dtype": v["dtype"], "categorical": v["categorical"], "long_name": display.display_name(has.get("long_name"), n), "units": display.display_units(has.get("units")), "attrs": {k: display.attr_value(x) for k, x in has.items()}}
        # False stands for missing data in a boolean variable
        cells = coarse.where(F.col(n)) if v["dtype"] == "bool" else coarse
        if v["categorical"]:
            rows = stats.categories(cells, n).collect()
            item["categories"] = [{"value": r.value, "color": r.color} for r in rows]
            ends = (float(rows[0].value), float(rows[-1].value)) if rows else (0.0, 1.0)
            found = spark.createDataFrame([ends], "lo double, hi double")
        else:
            found = stats.limits(cells, n)
        item["vmin"], item["vmax"] = stats.with_attrs(found, has).first()
        item["ticks"] = display.nice_ticks(item["vmin"], item["vmax"])
        item["colormap"] = display.colormap(has.get("cmap"))
        out.append(item)
    west, south, east, north = attrs["spatial:bbox"]
    crs = parse(p.doc["grid"]["crs"])
    return {
        "levels": [{"asset": x["asset"], "shape": x["spatial:shape"], "transform": x["spatial:transform"]} for x in layout],
        "dims": [{"name": d, "labels": display.labels(v)} for d, v in extra.items()], "variables": out, "bbox": attrs["spatial:bbox"],
        "crs": {"code": crs.code or "custom"} | ({"proj4": crs.proj4} if crs.code not in ("EPSG:4326", "EPSG:3857") and crs.proj4 else {}),
        "global": crs.geographic and abs(east - west - 360) <= 1e-6,
    }


def render_html(config: Mapping[str, Any], template: str) -> str:
    """A page with the configuration in it; ``template`` has the marks ``{{config}}`` and ``{{title}}``."""
    text = json.dumps(config).replace("</", "<\\/")
    title = re.sub(r"[<>&]", "", str(config.get("title", "pyramid")))
    return template.replace("{{config}}", text).replace("{{title}}", title)
