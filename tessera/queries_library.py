"""Registered queries of what the raster engine stores, plans, checks and shows, each through the package's own functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from functools import cache
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crs as crs_registry
from . import metadata
from .functions import columns, display
from .grid import Grid, GridError, Raster, Variable, axis_values, detect, sentinel
from .operators import lookup, stats
from .operators.blocks import block_centres, halve
from .plans import chunks
from .plans.levels import build_plan, dims_text, resolve_keepbits, resolve_methods, size_text
from .queries import EMB, EV, GEO, SHIP, _all_levels, _doubles, _plan_grid, _read, _sql_doubles, _sql_rounded, _variable, emb, ev, geo, geo_raster, register, ship, sql_halve
from .scratch import scratch_path
from .sources import zarr
from .store import Files, Pyramid, open_pyramid, read_config, to_pyramid
from .validate import close, validate
from .viewer import browser_url, check_store, store_name

_made: dict[tuple, str] = {}
RAISED, LOWERED = display.RAISED, display.LOWERED


def _scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "pyramid")


def _once(spark: SparkSession, key: tuple, make: Callable[[str], Any]) -> str:
    """The folder that ``make`` fills, once a session and input."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _made:
        path = _scratch(spark)
        make(path)
        _made[key] = path
    return _made[key]


def _rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# ---------------------------------------------------------------- stored pyramids


def emb_raster(spark: SparkSession, sf: str) -> Raster:
    cells = emb(spark, sf).select((-F.col("row")).cast("double").alias("y"), F.col("col").cast("double").alias("x"), "v")
    return Raster(cells, ("y", "x"), {"v": {"dtype": "float32", "units": "m yr-1", "long_name": r"$\Delta$ v_{2}"}}, attrs={"title": "embeddings", "history": "old", "multiscales": 1})


def ship_raster(spark: SparkSession, sf: str) -> Raster:
    cells = ship(spark, sf).select("yr", (-F.col("row")).cast("double").alias("y"), F.col("col").cast("double").alias("x"), "price", "qty", "flag")
    return Raster(cells, ("yr", "y", "x"), {"price": {"dtype": "float64"}, "qty": {"dtype": "int64"}, "flag": {"dtype": "int32", "_FillValue": -1, "flag_values": [0, 1, 2]}})


def stored_emb(spark: SparkSession, sf: str, **options) -> Pyramid:
    path = _once(spark, (sf, "emb", json.dumps(options)), lambda p: to_pyramid(emb_raster(spark, sf), p, crs="EPSG:3031", tile_size=64, **options))
    return open_pyramid(spark, path)


def stored_ship(spark: SparkSession, sf: str) -> Pyramid:
    methods = {"price": "max", "qty": "mean", "flag": "mode"}
    path = _once(spark, (sf, "ship"), lambda p: to_pyramid(ship_raster(spark, sf), p, crs=3031, tile_size=64, shard_size={"yr": 1, "y": 64, "x": 64}, resampling=methods, max_levels=3))
    return open_pyramid(spark, path)


def stored_geo(spark: SparkSession, sf: str) -> Pyramid:
    path = _once(spark, (sf, "geo"), lambda p: to_pyramid(geo_raster(spark, sf), p, tile_size=256))
    return open_pyramid(spark, path)


_N_EMB = "SELECT CAST(max(vec_id) + 1 AS INT) AS ny, CAST(max(len(embedding)) AS INT) AS nx FROM embeddings"
_LEVELS = f"""WITH RECURSIVE p(level, ny, nx) AS (SELECT 0, ny, nx FROM ({_N_EMB}) UNION ALL SELECT level + 1, CAST((ny + 1) // 2 AS INT), CAST((nx + 1) // 2 AS INT) FROM p WHERE greatest(ny, nx) > 64)"""
_E = {"v": ("mean", "f4")}

register("stored_emb_levels", lambda s, d: _doubles(stored_emb(s, d, max_levels=3).levels().select(F.col("level").cast("int"), "row", "col", "v"), "v"), _sql_doubles(_all_levels(EMB, 2, _E), "v"))
register("stored_level_shapes", lambda s, d: _rows(s, ((v.index, *v.shape, *v.bbox) for v in stored_emb(s, d).plan.levels), "level int, ny int, nx int, west double, south double, east double, north double"),
    f"{_LEVELS} SELECT level, ny, nx, -0.5::DOUBLE AS west, 0.5::DOUBLE - ny * 2 ** level AS south, -0.5::DOUBLE + nx * 2 ** level AS east, 0.5::DOUBLE AS north FROM p")
register("stored_keepbits", lambda s, d: _doubles(stored_emb(s, d, max_levels=2, keepbits=8).level(1).select("row", "col", "v"), "v"),
    _sql_rounded(sql_halve(f"SELECT row, col, CAST(v AS FLOAT) AS v FROM ({_sql_rounded(EMB, 8)})", _E), 8))
_SHIP_STORED = {"price": ("max", "f"), "qty": ("mean", "i"), "flag": ("mode", "i")}
register("stored_ship_l2", lambda s, d: stored_ship(s, d).level(2).select("yr", "row", "col", "price", "qty", "flag"), sql_halve(sql_halve(SHIP, _SHIP_STORED, ("yr",)), _SHIP_STORED, ("yr",)))
register("stored_geo_level", lambda s, d: stored_geo(s, d).level(1).select("row", "col", "total"), sql_halve(GEO, {"total": ("mean", "f")}))


def stored_group(spark: SparkSession, sf: str) -> DataFrame:
    """A pyramid in a sub-group: its last level."""
    path = _once(spark, (sf, "group"), lambda p: to_pyramid(emb_raster(spark, sf), p, group="/maps/a/", crs=3031, tile_size=64, max_levels=2, resampling={"v": "max"}))
    return _doubles(open_pyramid(spark, path, "maps/a").level(1).select("row", "col", "v"), "v")


register("stored_group", stored_group, _sql_doubles(sql_halve(EMB, {"v": ("max", "f4")}), "v"))


def overwriting(spark: SparkSession, sf: str) -> DataFrame:
    """What writing again to a pyramid, over it and to a folder with other things does."""
    files, rows, path = Files(spark), [], stored_geo(spark, sf).path
    other = _scratch(spark)
    files.write(f"{other}/keep.txt", "mine")
    fresh = _scratch(spark)
    to_pyramid(geo_raster(spark, sf), fresh, tile_size=256)
    for case, at, over in (("again", path, False), ("other things", other, True), ("over it", fresh, True), ("bad group", None, False)):
        try:
            to_pyramid(geo_raster(spark, sf), at or fresh, group=None if at else "a/../b", tile_size=256, overwrite=over)
            rows.append((case, "written"))
        except (FileExistsError, ValueError) as e:
            rows.append((case, type(e).__name__))
    return _rows(spark, rows, "case string, outcome string")


register("overwriting", overwriting, "SELECT * FROM (VALUES ('again', 'FileExistsError'), ('other things', 'FileExistsError'), ('over it', 'written'), ('bad group', 'ValueError')) AS t(\"case\", outcome)")


def stored_zarr(spark: SparkSession, sf: str, preset: str) -> str:
    return _once(spark, (sf, "zarr", preset), lambda p: zarr.export(stored_ship(spark, sf), p, preset))


def zarr_cells(spark: SparkSession, sf: str, preset: str, level: int) -> DataFrame:
    """All variables of a level, read back from the exported arrays in one pass."""
    path = f"{stored_zarr(spark, sf, preset)}/{level}"
    found = zarr.read_arrays(spark, {n: f"{path}/{n}" for n in ("price", "qty", "flag")})
    return found.select(F.col("yr").cast("int"), F.col("y").cast("int").alias("row"), F.col("x").cast("int").alias("col"), "price", "qty", "flag")


_YEARS = "SELECT yr, CAST(row_number() OVER (ORDER BY yr) - 1 AS INT) AS k FROM (SELECT DISTINCT year(l_shipdate) AS yr FROM lineitem)"
for _preset, _level, _sql in (("web", 0, SHIP), ("zstd", 1, sql_halve(SHIP, _SHIP_STORED, ("yr",)))):
    register(f"zarr_{_preset}", lambda s, d, p=_preset, k=_level: zarr_cells(s, d, p, k), f"SELECT k AS yr, row, col, price, qty, flag FROM ({_sql}) a JOIN ({_YEARS}) b ON a.yr = b.yr")


def zarr_units(spark: SparkSession, sf: str) -> DataFrame:
    """The write units that are stored: those without a value aren't. A unit is one chunk, as the shard asked for is one."""
    path, rows = f"{stored_zarr(spark, sf, 'web')}/0", []
    for name in ("price", "flag"):
        array = zarr.Array.open(f"{path}/{name}")
        for n in range(int(np.prod(array.counts))):
            if (block := array.block(n)) is not None:
                rows.append((name, *(int(i) for i in np.unravel_index(n, array.counts)), int(array.real(block).sum())))
    return _rows(spark, rows, "variable string, t int, r int, c int, n long")


_UNITS = f"SELECT k AS t, row // 64 AS r, col // 64 AS c, count(price) AS price, count(flag) AS flag FROM ({SHIP}) a JOIN ({_YEARS}) b ON a.yr = b.yr GROUP BY ALL"
register("zarr_units", zarr_units, f"SELECT 'price' AS variable, t, r, c, price AS n FROM ({_UNITS}) UNION ALL SELECT 'flag', t, r, c, flag FROM ({_UNITS})")


def zarr_raster(spark: SparkSession, sf: str) -> DataFrame:
    """An exported level opened as a raster again, some of its variables, and detected once more."""
    raster = zarr.open_raster(spark, f"{stored_zarr(spark, sf, 'web')}/0", ["qty"])
    found = detect(raster, crs=3031)
    return found.cells.where("qty is not null").select(F.col("yr").cast("int"), "row", "col", "qty")


register("zarr_raster", zarr_raster, f"SELECT yr, row, col, qty FROM ({SHIP})")


def zarr_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What the consolidated metadata of the exported root says of each level's variables."""
    path = stored_zarr(spark, sf, "web")
    docs = json.loads(zarr._get(f"{path}/zarr.json"))["consolidated_metadata"]["metadata"]
    rows = [(n, d["shape"][-2], d["shape"][-1], d["codecs"][-1]["configuration"].get("shuffle"), d["attributes"].get("resampling_method")) for n, d in docs.items() if n.partition("/")[2] in ("price", "qty", "flag")]
    return _rows(spark, rows, "name string, ny int, nx int, shuffle string, method string")


register("zarr_metadata", zarr_metadata, """WITH s AS (SELECT max(l_suppkey) + 1 AS ny, max(dayofyear(l_shipdate)) AS nx FROM lineitem), k AS (SELECT unnest(range(0, 3)) AS level),
v AS (SELECT * FROM (VALUES ('price', 'bitshuffle', 'max'), ('qty', 'shuffle', 'average'), ('flag', 'shuffle', 'mode')) AS t(v, shuffle, m))
SELECT level || '/' || v AS name, CAST(ceil(ny / 2 ** level) AS INT) AS ny, CAST(ceil(nx / 2 ** level) AS INT) AS nx, shuffle, CASE WHEN level > 0 THEN m END AS method FROM s, k, v""")


# ---------------------------------------------------------------- configuration and checks


def config_variables(spark: SparkSession, sf: str) -> DataFrame:
    c = read_config(spark, stored_emb(spark, sf, max_levels=3).path)
    return _rows(spark, ((v["name"], v["long_name"], v["units"], v["categorical"], round(v["vmin"], 6), round(v["vmax"], 6), c["global"], c["crs"]["code"]) for v in c["variables"]), "name string, long_name string, units string, categorical boolean, lo double, hi double, is_global boolean, crs string")


_COARSE = sql_halve(sql_halve(EMB, _E), _E)
register("config_variables", config_variables, f"SELECT 'v' AS name, 'Δv₂' AS long_name, 'm yr⁻¹' AS units, false AS categorical, round(quantile_cont(CAST(v AS DOUBLE), 0.02), 6) AS lo, round(quantile_cont(CAST(v AS DOUBLE), 0.98), 6) AS hi, false AS is_global, 'EPSG:3031' AS crs FROM ({_COARSE})")


def config_categories(spark: SparkSession, sf: str) -> DataFrame:
    """The categories of the coarsest level's first slice."""
    c = read_config(spark, stored_ship(spark, sf).path)
    flag = next(v for v in c["variables"] if v["name"] == "flag")
    return _rows(spark, ((int(x["value"]), x["color"]) for x in flag["categories"]), "value long, color string")


_FLAGS = sql_halve(sql_halve(SHIP, _SHIP_STORED, ("yr",)), _SHIP_STORED, ("yr",))
register("config_categories", config_categories, f"SELECT CAST(flag AS BIGINT) AS value, ['{"', '".join(display.PALETTE)}'][row_number() OVER (ORDER BY flag)] AS color FROM (SELECT DISTINCT flag FROM ({_FLAGS}) WHERE yr = (SELECT min(year(l_shipdate)) FROM lineitem) AND flag IS NOT NULL)")


def config_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Levels, dimensions and the global flag of longitudes and latitudes."""
    c = read_config(spark, stored_geo(spark, sf).path)
    return _rows(spark, ((int(x["asset"]), *x["shape"], c["global"], c["crs"]["code"], *c["bbox"]) for x in c["levels"]), "level int, ny int, nx int, is_global boolean, crs string, west double, south double, east double, north double")


register("config_layout", config_layout, "SELECT * FROM (VALUES (0, 180, 360, true, 'EPSG:4326', -180.0::DOUBLE, -90.0::DOUBLE, 180.0::DOUBLE, 90.0::DOUBLE), (1, 90, 180, true, 'EPSG:4326', -180.0, -90.0, 180.0, 90.0)) AS t(level, ny, nx, is_global, crs, west, south, east, north)")
register("config_labels", lambda s, d: _rows(s, ((k, v) for k, v in enumerate(read_config(s, stored_ship(s, d).path)["dims"][0]["labels"])), "k int, label int"), f"SELECT k, CAST(yr AS INT) AS label FROM ({_YEARS})")
register("attr_limits", lambda s, d: stats.with_attrs(stats.limits(emb(s, d), "v"), {"vmin": -0.1}).select("lo", F.round("hi", 6).alias("hi")),
    f"SELECT -0.1::DOUBLE AS lo, round(CASE WHEN q > -0.1 THEN q ELSE 0.9 END, 6) AS hi FROM (SELECT quantile_cont(CAST(v AS DOUBLE), 0.98) AS q FROM ({EMB}))")


def faulty(spark: SparkSession, sf: str) -> str:
    """A pyramid that was written whole and then damaged."""

    def make(path: str) -> None:
        to_pyramid(emb_raster(spark, sf), path, crs=3031, tile_size=64, max_levels=3)
        files = Files(spark)
        doc = json.loads(files.read(f"{path}/_pyramid.json"))
        doc["attrs"]["multiscales"]["layout"][1]["derived_from"] = "7"
        doc["attrs"]["zarr_conventions"] = doc["attrs"]["zarr_conventions"][:2]
        doc["levels"]["0"]["attrs"]["spatial:shape"] = [3, 3]
        del doc["levels"]["1"]["attrs"]["spatial:transform"]
        files.write(f"{path}/_pyramid.json", json.dumps(doc))
        files.delete(f"{path}/level=2")

    return _once(spark, (sf, "faulty"), make)


def _report(spark: SparkSession, report: dict[str, list[str]]) -> DataFrame:
    return _rows(spark, ((k, len(v)) for k, v in report.items()), '"check" string, n int'.replace('"check"', "kind"))


register("validate_faults", lambda s, d: _report(s, validate(s, faulty(s, d))), "SELECT * FROM (VALUES ('zarr_conventions', 1), ('multiscales', 1), ('spatial', 3), ('proj', 0), ('structure', 1)) AS t(kind, n)")
register("validate_plan", lambda s, d: _report(s, validate(s, stored_emb(s, d).path, plan=build_plan(detect(emb_raster(s, d), 3031).grid, tile_size=64, max_levels=1))), f"{_LEVELS} SELECT kind, CAST(n AS INT) AS n FROM (VALUES ('zarr_conventions', 0), ('multiscales', 0), ('spatial', 0), ('proj', 0), ('structure', CASE WHEN (SELECT max(level) FROM p) > 0 THEN 1 ELSE 0 END)) AS t(kind, n)")


def validate_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A level that lost the blocks of an even row: how many a check of the cells finds."""

    def make(path: str) -> None:
        to_pyramid(geo_raster(spark, sf), path, tile_size=256)
        spark.read.parquet(f"{path}/level=1").where("row <> 40").write.mode("overwrite").parquet(f"{path}/kept")
        Files(spark).delete(f"{path}/level=1")
        spark.read.parquet(f"{path}/kept").write.parquet(f"{path}/level=1")

    return _rows(spark, [tuple(validate(spark, _once(spark, (sf, "holes"), make), cells=True)["structure"])], "message string")


register("validate_cells", validate_cells, f"SELECT 'level 1 lacks ' || count(*) || ' blocks' AS message FROM (SELECT DISTINCT row // 2, col // 2 FROM ({GEO}) WHERE row // 2 = 40)")


# ---------------------------------------------------------------- grids


def grid_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    g = geo(spark, sf).grid
    return _rows(spark, [(g.x, g.y, g.crs.code, *g.shape, g.transform[0], g.transform[4], *g.bbox)], "x string, y string, crs string, ny int, nx int, dx double, dy double, west double, south double, east double, north double")


register("grid_of_orders", grid_of_orders, "SELECT 'lon' AS x, 'lat' AS y, 'EPSG:4326' AS crs, CAST(count(DISTINCT o_orderkey % 180) AS INT) AS ny, CAST(count(DISTINCT o_custkey % 360) AS INT) AS nx, 1.0::DOUBLE AS dx, -1.0::DOUBLE AS dy, -180.0::DOUBLE AS west, min(o_orderkey % 180)::DOUBLE - 90 AS south, 180.0::DOUBLE AS east, max(o_orderkey % 180)::DOUBLE - 89 AS north FROM orders")


def grid_variables(spark: SparkSession, sf: str) -> DataFrame:
    """What detection says of a raster's variables: types, categories, fills; one without a spatial dimension goes."""
    r = ship_raster(spark, sf)
    cells = r.df.withColumns({"hot": F.col("price") > 5, "n": F.lit(1)})
    found = detect(Raster(cells, r.dims, {**r.variables, "hot": {}, "n": {}}), crs=3031, sizes={"n": ("yr",)})
    return _rows(spark, ((v.name, v.dtype, v.categorical, None if v.kind == "f" else int(v.fill), v.declared, len(v.dims)) for v in found.grid.variables), "name string, dtype string, categorical boolean, fill long, declared boolean, dims int")


register("grid_variables", grid_variables, "SELECT * FROM (VALUES ('price', 'float64', false, NULL::BIGINT, false, 3), ('qty', 'int64', true, -9223372036854775808, false, 3), ('flag', 'int32', true, -1, true, 3), ('hot', 'bool', true, 0, false, 3)) AS t(name, dtype, categorical, fill, declared, dims)")


def grid_errors(spark: SparkSession, sf: str) -> DataFrame:
    """What detection does with rasters it can't take, and with an axis of one pixel."""
    cells = geo_raster(spark, sf).df.select(F.col("lat").alias("y"), F.col("lon").alias("x"), "total")
    column = cells.groupBy("y").agg(F.max("total").alias("total")).withColumn("x", F.lit(7.5))
    of = lambda df=cells, dims=("y", "x"), **more: Raster(df, dims, {"total": {}}, **more)
    cases = {
        "no crs": (of(), {}), "unknown names": (of(cells.toDF("p", "q", "total"), ("p", "q")), {"crs": 3031}), "descending x": (of(coords={"x": {"order": "descending"}}), {"crs": 3031}),
        "curvilinear": (of(coords={"x": {"dims": ["y", "x"]}}), {"crs": 3031}), "irregular": (of(cells.where("x <> 7.5")), {"crs": 3031}), "empty": (of(cells.where("x < 0")), {"crs": 3031}),
        "one pixel": (of(column), {"crs": 3031}), "one pixel with its size": (of(column, attrs={"res": 2.0}), {"crs": 3031}),
        "by axis": (of(cells.toDF("p", "q", "total"), ("p", "q"), coords={"q": {"axis": "X"}, "p": {"axis": "Y"}}), {"crs": 3031}),
        "named": (of(cells.withColumnRenamed("y", "north"), named={"y": "north"}), {"crs": 3031}),
    }
    rows = []
    for case, (raster, options) in cases.items():
        try:
            g = detect(raster, **options).grid
            rows.append((case, "found", g.shape[0], g.transform[0]))
        except GridError:
            rows.append((case, "error", None, None))
    return _rows(spark, rows, "kind string, outcome string, ny int, dx double")


register("grid_errors", grid_errors, """SELECT kind, outcome, CASE WHEN outcome = 'found' THEN (SELECT CAST(max(o_orderkey % 180) - min(o_orderkey % 180) + 1 AS INT) FROM orders) END AS ny, dx
FROM (VALUES ('no crs', 'error', NULL::DOUBLE), ('unknown names', 'error', NULL), ('descending x', 'error', NULL), ('curvilinear', 'error', NULL), ('irregular', 'error', NULL), ('empty', 'error', NULL), ('one pixel', 'error', NULL), ('one pixel with its size', 'found', 2.0), ('by axis', 'found', 1.0), ('named', 'found', 1.0)) AS t(kind, outcome, dx)""")
register("crs_codes", lambda s, d: _rows(s, ((r.n_nationkey, (c := crs_registry.parse(f"EPSG:{32601 + r.n_nationkey}")).code, c.proj4, c.geographic) for r in _read(s, d, "nation").collect()), "k int, code string, proj4 string, geographic boolean"),
    "SELECT n_nationkey AS k, 'EPSG:' || (32601 + n_nationkey) AS code, '+proj=utm +zone=' || (n_nationkey + 1) || ' +datum=WGS84 +units=m +no_defs' AS proj4, false AS geographic FROM nation")
register("block_centres", lambda s, d: _rows(s, enumerate(float(x) for x in block_centres(geo(s, d).ys)), "k int, centre double"),
    "SELECT CAST(row_number() OVER (ORDER BY b DESC) - 1 AS INT) AS k, CAST(b AS DOUBLE) AS centre FROM (SELECT DISTINCT max(v) OVER () - 2 * (CAST(max(v) OVER () - v AS INT) // 2) - 0.5 AS b FROM (SELECT DISTINCT -89.5 + o_orderkey % 180 AS v FROM orders))")
register("fill_of_columns", lambda s, d: _rows(s, ((c, sentinel({"int": "int32", "bigint": "int64"}[t])) for c, t in _read(s, d, "lineitem").dtypes if t in ("int", "bigint")), "name string, fill long"),
    "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN -9223372036854775808 ELSE -2147483648 END AS fill FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER')")

# ---------------------------------------------------------------- plans


def _columns_grid(spark: SparkSession, sf: str) -> Grid:
    kinds = {"int": "int32", "bigint": "int64", "double": "float64"}
    found = [(c, kinds[t]) for c, t in _read(spark, sf, "lineitem").dtypes if t in kinds]
    n = _read(spark, sf, "lineitem").count()
    variables = tuple(Variable(c, t, ("y", "x"), (n, 300), t != "float64", None, False) for c, t in found)
    return Grid("x", "y", crs_registry.parse(3031), (n, 300), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), variables, ())


register("plan_methods", lambda s, d: _rows(s, resolve_methods(_columns_grid(s, d), {"l_tax": "min", "l_linenumber": "nearest"}).items(), "name string, method string"),
    "SELECT column_name AS name, CASE WHEN column_name = 'l_tax' THEN 'min' WHEN column_name = 'l_linenumber' THEN 'nearest' WHEN column_type = 'DOUBLE' THEN 'mean' ELSE 'mode' END AS method FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")
register("plan_tiles", lambda s, d: build_plan(_columns_grid(s, d), tile_size={"l_tax": 100}, max_levels=1).to_df(s).select("variable", F.col("chunks")[0].alias("cy"), F.col("chunks")[1].alias("cx")),
    "SELECT column_name AS variable, CAST(least((SELECT count(*) FROM lineitem), CASE WHEN column_name = 'l_tax' THEN 100 ELSE 512 END) AS INT) AS cy, CASE WHEN column_name = 'l_tax' THEN 100 ELSE 300 END AS cx FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')")
register("plan_keepbits", lambda s, d: _rows(s, resolve_keepbits(_columns_grid(s, d), 12).items(), "name string, bits int"), "SELECT column_name AS name, 12 AS bits FROM (DESCRIBE lineitem) WHERE column_type = 'DOUBLE'")


def _sizes(spark: SparkSession, sf: str) -> list[int]:
    return [r.p_size for r in _read(spark, sf, "part").select("p_size").distinct().collect()]


register("fixed_chunks", lambda s, d: _rows(s, ((n, *(lay := chunks.given((3, n * 10, n * 20), 4, 64, (2, 128, 256))).chunks[1:], *(lay.shards or (0, 0, 0))) for n in _sizes(s, d)), "n int, cy int, cx int, st int, sy int, sx int"),
    """SELECT n, cy, cx, 2 AS st, CAST(least(128, ceil(ny / cy) * cy) AS INT) AS sy, CAST(least(256, ceil(nx / cx) * cx) AS INT) AS sx
FROM (SELECT *, least(64, ny) AS cy, least(64, nx) AS cx FROM (SELECT DISTINCT p_size AS n, p_size * 10 AS ny, p_size * 20 AS nx FROM part))""")  # fmt: skip
register("automatic_chunks", lambda s, d: _rows(s, ((n, *(lay.shards or (0, 0, 0))) for n in _sizes(s, d) for lay in [chunks.automatic((40, n * 100, n * 50), 8)]), "n int, st int, sy int, sx int"),
    """WITH a AS (SELECT DISTINCT p_size AS n, p_size * 100 AS ny, p_size * 50 AS nx FROM part), b AS (SELECT *, least(512, ny) AS cy, least(512, nx) AS cx FROM a), c AS (SELECT *, CAST(ceil(ny / cy) * cy AS INT) AS wy, CAST(ceil(nx / cx) * cx AS INT) AS wx FROM b),
d AS (SELECT *, least(4096, wy) AS sy, least(4096, wx) AS sx FROM c)
SELECT n, CASE WHEN sy >= ny AND sx >= nx THEN CAST(greatest(1, least(40, 134217728 // (sy * sx * 8))) AS INT) ELSE 1 END AS st, CAST(sy AS INT) AS sy, CAST(sx AS INT) AS sx FROM d""")  # fmt: skip
register("parsed_sizes", lambda s, d: _rows(s, ((n, chunks.parse_size(f"{n}MiB"), chunks.parse_size(f" {n}.5 kb ")) for n in _sizes(s, d)), "n int, big long, small long"),
    "SELECT DISTINCT p_size AS n, p_size::BIGINT * 1048576 AS big, p_size::BIGINT * 1000 + 500 AS small FROM part")

# ---------------------------------------------------------------- metadata

_PG = """WITH RECURSIVE s AS (SELECT CAST((max(vec_id) + 1) * 8 AS INT) AS ny, CAST(max(len(embedding)) * 40 AS INT) AS nx FROM embeddings),
p(level, ny, nx) AS (SELECT 0, ny, nx FROM s UNION ALL SELECT level + 1, CAST((ny + 1) // 2 AS INT), CAST((nx + 1) // 2 AS INT) FROM p WHERE greatest(ny, nx) > 256)"""


def level_metadata(spark: SparkSession, sf: str) -> DataFrame:
    plan, rows = _plan_grid(spark, sf), []
    for v in plan.levels:
        a = metadata.level_attrs(plan, v.index)
        rows.append((v.index, *a["spatial:shape"], a["spatial:transform"][0], a["spatial:bbox"][2], a["proj:code"], a["spatial:registration"], ",".join(c["name"] for c in a["zarr_conventions"])))
    return _rows(spark, rows, "level int, ny int, nx int, dx double, east double, code string, registration string, conventions string")


register("level_metadata", level_metadata, _PG + " SELECT level, ny, nx, 30.0::DOUBLE * 2 ** level AS dx, 30.0::DOUBLE * 2 ** level * nx AS east, 'EPSG:3031' AS code, 'pixel' AS registration, 'spatial:,proj:' AS conventions FROM p")


def root_layout(spark: SparkSession, sf: str) -> DataFrame:
    m = metadata.root_attrs(_plan_grid(spark, sf))["multiscales"]
    return _rows(spark, ((x["asset"], x.get("derived_from"), (x.get("transform") or {}).get("scale", [None])[0], *x["spatial:shape"], m["resampling_method"]) for x in m["layout"]), "asset string, origin string, scale double, ny int, nx int, method string")


register("root_layout", root_layout, _PG + " SELECT CAST(level AS VARCHAR) AS asset, CASE WHEN level > 0 THEN CAST(level - 1 AS VARCHAR) END AS origin, CASE WHEN level > 0 THEN 2.0::DOUBLE END AS scale, ny, nx, 'average' AS method FROM p")


def root_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a source's attributes a root keeps: nations' names, some managed ones among them."""
    names = [r.n_name for r in _read(spark, sf, "nation").collect()]
    own = {n: 1 for n in names} | {f"proj:{n}": 1 for n in names} | {f"spatial:{n}": 1 for n in names} | {"multiscales": 1, "history": "old"}
    return _rows(spark, ((k, "old" if k == "history" else "") for k, v in metadata.own_attrs(own).items() if k != "history" or str(v).startswith("old\n")), "name string, kept string")


register("root_sources", root_sources, "SELECT DISTINCT n_name AS name, '' AS kept FROM nation UNION ALL SELECT 'history', 'old'")


def cf_metadata(spark: SparkSession, sf: str) -> DataFrame:
    plan = _plan_grid(spark, sf)
    made = {v.index: metadata.cf_attrs(plan, v.index) for v in plan.levels}
    return _rows(spark, ((k, a["spatial_ref"]["GeoTransform"], a["x"]["standard_name"], a["y"]["axis"], a["v"].get("resampling_method"), a["v"]["grid_mapping"]) for k, a in made.items()), "level int, place string, x string, axis string, method string, mapping string")


register("cf_metadata", cf_metadata, _PG + " SELECT level, '0.0 ' || CAST(30.0::DOUBLE * 2 ** level AS VARCHAR) || ' 0.0 0.0 0.0 ' || CAST(-30.0::DOUBLE * 2 ** level AS VARCHAR) AS place, 'projection_x_coordinate' AS x, 'Y' AS axis, CASE WHEN level > 0 THEN 'average' END AS method, 'spatial_ref' AS mapping FROM p")
register("conventions", lambda s, d: _rows(s, ((k, c["uuid"]) for k, c in metadata.CONVENTIONS.items()), "name string, id string"), "SELECT * FROM (VALUES ('multiscales', 'd35379db-88df-4056-af3a-620245f8e347'), ('spatial', '689b58e2-cf7b-45e0-9fff-9cfc0883d6b4'), ('proj', 'f17cb550-5864-4468-aeb7-f3180cfb622f')) AS t(name, id)")

# ---------------------------------------------------------------- blocks

_HOT = _variable("hot", "bool", fill=False)
_HOT4 = ", ".join(f"max(CASE WHEN (row % 2) * 2 + col % 2 = {k} THEN CAST(hot AS INT) END) AS h{k}" for k in range(4))
for _m, _made_sql in (("mean", "round_even(CAST(coalesce(h0, 0) + coalesce(h1, 0) + coalesce(h2, 0) + coalesce(h3, 0) AS DOUBLE) / (CAST(h0 IS NOT NULL AS INT) + CAST(h1 IS NOT NULL AS INT) + CAST(h2 IS NOT NULL AS INT) + CAST(h3 IS NOT NULL AS INT)), 0) = 1"), ("min", "least(h0, h1, h2, h3) = 1"), ("max", "greatest(h0, h1, h2, h3) = 1")):
    register(f"ev_l1_bool_{_m}", lambda s, d, m=_m: halve(ev(s, d).select("kind", "row", "col", "hot").where("hot is not null"), [(_HOT, m)], ["kind"]),
        f"SELECT kind, row, col, {_made_sql} AS hot FROM (SELECT kind, row // 2 AS row, col // 2 AS col, {_HOT4} FROM ({EV}) WHERE hot IS NOT NULL GROUP BY kind, row // 2, col // 2)")

# ---------------------------------------------------------------- what is shown


def _digits(of: str, small: str) -> str:
    return f"translate(CAST({of} AS VARCHAR), '0123456789', '{small}')"


register("display_names", lambda s, d: _rows(s, ((r.n_nationkey, display.display_name(f"$\\mathrm{{{r.n_name.partition('_')[0]}}}_{{{r.n_nationkey}}}$ of  \\alpha^{r.n_regionkey}", "v")) for r in _read(s, d, "nation").collect()), "k int, name string"),
    f"SELECT n_nationkey AS k, split_part(n_name, '_', 1) || {_digits('n_nationkey', LOWERED)} || ' of α' || {_digits('n_regionkey', RAISED)} AS name FROM nation")
register("display_units", lambda s, d: _rows(s, ((r.r_regionkey, display.display_units(f"m yr-{r.r_regionkey}"), display.display_units("degC")) for r in _read(s, d, "region").collect()), "k int, unit string, alias string"),
    f"SELECT r_regionkey AS k, 'm yr⁻' || {_digits('r_regionkey', RAISED)} AS unit, '°C' AS alias FROM region")
register("display_attrs", lambda s, d: _rows(s, ((r.r_regionkey, display.attr_value([np.int32(r.r_regionkey), r.r_name]), display.attr_value(r.r_name * 400), display.token(r.r_name, "{}")) for r in _read(s, d, "region").collect()), "k int, listed string, cut string, token string"),
    "SELECT r_regionkey AS k, r_regionkey || ', ' || r_name AS listed, CASE WHEN length(r_name) > 5 THEN substr(repeat(r_name, 400), 1, 2000) || '…' ELSE repeat(r_name, 400) END AS cut, substr(sha1(r_name || chr(0) || '{}'), 1, 12) AS token FROM region")


def _ranges(spark: SparkSession, sf: str) -> list:
    rows = _read(spark, sf, "customer").groupBy("c_nationkey").agg(F.floor(F.min("c_acctbal")).alias("lo"), F.ceil(F.max("c_acctbal")).alias("hi"))
    return rows.where("hi > lo").collect()


_CANDIDATES = """WITH r AS (SELECT c_nationkey AS k, floor(min(c_acctbal)) AS lo, ceil(max(c_acctbal)) AS hi FROM customer GROUP BY 1 HAVING ceil(max(c_acctbal)) > floor(min(c_acctbal))),
s AS (SELECT m * 10 ** e AS step FROM (SELECT unnest([1, 2, 5]) AS m) CROSS JOIN (SELECT unnest(range(0, 5)) AS e)),
c AS (SELECT k, step, CAST(ceil(lo / step) AS BIGINT) AS a, CAST(floor(hi / step) AS BIGINT) AS b FROM r, s),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY abs(b - a + 1 - 5), step DESC) AS nth FROM c WHERE b - a + 1 BETWEEN 4 AND 6)"""
register("nice_ticks", lambda s, d: _rows(s, ((r.c_nationkey, t) for r in _ranges(s, d) for t in display.nice_ticks(r.lo, r.hi)), "k int, tick double"), f"{_CANDIDATES} SELECT k, CAST(unnest(range(a, b + 1)) * step AS DOUBLE) AS tick FROM t WHERE nth = 1")
register("log_ticks", lambda s, d: _rows(s, ((n, t) for n in _sizes(s, d) for t in display.log_ticks(float(n), 20.0 * n)), "n int, tick double"), """WITH n AS (SELECT DISTINCT p_size AS n FROM part), t AS (SELECT n, m, m * 10 ** e AS tick FROM n, (SELECT unnest([1, 2, 5]) AS m), (SELECT unnest(range(0, 4)) AS e) WHERE m * 10 ** e BETWEEN n AND 20 * n),
c AS (SELECT n, count(*) AS c, count(*) FILTER (WHERE m = 1) AS d FROM t GROUP BY n) SELECT n, CAST(tick AS DOUBLE) AS tick FROM t JOIN c USING (n) WHERE c <= 6 OR m = 1""")
register("significant", lambda s, d: _read(s, d, "part").select("p_partkey", columns.significant(F.col("p_retailprice") / 3).alias("v")), "SELECT p_partkey, CAST(format('{:.9e}', p_retailprice / 3) AS DOUBLE) AS v FROM part")


def _ramp_sql(stops: list[tuple[int, int, int]], place: str) -> str:
    one = lambda k: f"list_value({', '.join(str(s[k]) for s in stops)})"
    at = f"CAST(least(floor(p), {len(stops) - 2}) AS INT)"
    made = ", ".join(f"CAST(round_even({one(k)}[{at} + 1] + ({one(k)}[{at} + 2] - {one(k)}[{at} + 1]) * (p - {at}), 0) AS INT) AS {c}" for k, c in enumerate("rgb"))
    return f"SELECT p_partkey, {made} FROM (SELECT p_partkey, {place} AS p FROM part)"


@cache
def _stops(name: str) -> tuple:
    return tuple(display.colormap(name))


def colormap_values(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the colours of a map, by size from 1 to 50."""
    rgb = columns.ramp(F.col("p_size"), 1.0, 50.0, list(_stops("viridis_r")))
    return _read(spark, sf, "part").select("p_partkey", *(rgb[k].alias(c) for k, c in enumerate("rgb")))


register("colormap_values", colormap_values, _ramp_sql(list(_stops("viridis_r")), f"least(1.0, greatest(0.0, (p_size - 1.0::DOUBLE) / 49.0::DOUBLE)) * {len(_stops('viridis_r')) - 1}"))
register("symmetric_maps", lambda s, d: _rows(s, ((n, display.symmetric_colormap(n)) for n in display.COLORMAPS), "name string, symmetric string"), f"SELECT name, CASE WHEN name = 'rdbu' THEN 'rdbu' ELSE 'rdbu_r' END AS symmetric FROM (SELECT unnest({list(display.COLORMAPS)}) AS name)")
register("point_readout", lambda s, d: _doubles(lookup.sample([(stored_emb(s, d).level(v.index), v.transform, v.shape) for v in stored_emb(s, d).plan.levels], 10.2, -20.3), "v").select("row", "col", "v"), f"SELECT row, col, CAST(v AS DOUBLE) AS v FROM ({EMB}) WHERE row = 20 AND col = 10")
register("axis_of_orders", lambda s, d: _rows(s, enumerate(float(v) for v in axis_values(geo_raster(s, d).df, "lon")), "k int, v double"), "SELECT CAST(row_number() OVER (ORDER BY v) - 1 AS INT) AS k, CAST(v AS DOUBLE) AS v FROM (SELECT DISTINCT 0.5 + o_custkey % 360 AS v FROM orders)")


def store_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What a check says of an exported pyramid, one of its levels, one of its arrays, its parent folder and no place at all."""
    path = stored_zarr(spark, sf, "web")
    places = {"pyramid": path, "level": f"{path}/0", "array": f"{path}/0/qty", "parent": path.rpartition("/")[0], "nothing": f"{path}/none", "empty": "", "scheme": "ftp://a/b"}
    return _rows(spark, ((k, check_store(p).code or "ok") for k, p in places.items()), "place string, outcome string")


register("store_checks", store_checks, "SELECT * FROM (VALUES ('pyramid', 'ok'), ('level', 'not_pyramid'), ('array', 'not_group'), ('parent', 'not_zarr'), ('nothing', 'not_found'), ('empty', 'empty'), ('scheme', 'unsupported_scheme')) AS t(place, outcome)")
register("store_names", lambda s, d: _rows(s, ((r.r_regionkey, store_name(f"s3://maps/{r.r_name}.zarr/"), browser_url(f"s3://maps/{r.r_name}.zarr")) for r in _read(s, d, "region").collect()), "k int, name string, url string"),
    "SELECT r_regionkey AS k, r_name AS name, 'https://maps.s3.amazonaws.com/' || replace(r_name, ' ', '%20') || '.zarr' AS url FROM region")
register("bounds_close", lambda s, d: _rows(s, ((r.n_nationkey, close([r.n_nationkey, 1.0], [r.n_nationkey * (1 + 1e-10), 1.0]), close([float(r.n_nationkey)], [r.n_nationkey + 1e-6]), close([1.0], [1.0, 2.0])) for r in _read(s, d, "nation").collect()), "k int, near boolean, far boolean, longer boolean"),
    "SELECT n_nationkey AS k, true AS near, n_nationkey * 1e-9 >= 1e-6 AS far, false AS longer FROM nation")
register("plan_text", lambda s, d: _rows(s, ((v.index, size_text(v.nbytes, "KiB", "MiB"), dims_text(v.shape)) for v in _plan_grid(s, d).levels), "level int, size string, shape string"),
    _PG + " SELECT level, CASE WHEN b >= 1048576 THEN format('{:.1f} MiB', b / 1048576.0::DOUBLE) ELSE format('{:.1f} KiB', b / 1024.0::DOUBLE) END AS size, CASE WHEN ny = nx THEN ny || '²' ELSE ny || '×' || nx END AS shape FROM (SELECT *, CAST(ny AS BIGINT) * nx * 4 AS b FROM p)")


def frame_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The values of the first year at the finest level, thinned to some thousands."""
    p = stored_ship(spark, sf)
    year = min(p.doc["grid"]["extra"]["yr"])
    found = lookup.frame_values([(p.level(v.index), v.shape) for v in p.plan.levels], {"yr": year}, most=5000)
    return found.where("price is not null").select("row", "col", "price")


register("frame_sample", frame_sample, f"""WITH n AS (SELECT max(l_suppkey) + 1 AS ny, max(dayofyear(l_shipdate)) AS nx FROM lineitem), s AS (SELECT min(k) AS k FROM n, (SELECT unnest(range(1, 200)) AS k) WHERE ceil(ny / k) * ceil(nx / k) <= 5000)
SELECT row, col, price FROM ({SHIP}), s WHERE yr = (SELECT min(year(l_shipdate)) FROM lineitem) AND row % k = 0 AND col % k = 0""")
