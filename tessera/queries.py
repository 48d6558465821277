"""The registered queries of the raster engine, each with DuckDB SQL, over grids made from the test tables.

``emb``: the embeddings as a grid of vectors by components. ``ship``: line items by supplier and day of the year, a
slice for each year. ``ev``: events by user and hour, a slice for each type. ``geo``: orders by latitude and
longitude from 0 to 360.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, display
from .grid import Found, Grid, Raster, Variable, axis_values, check_regular, detect, grid_step
from .crs import parse
from .operators import lookup, stats
from .operators.blocks import halve
from .operators.quantize import quantize
from .plans.levels import build_plan
from .scratch import stored
from .validate import missing_blocks

DOUBLE = "double"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _variable(name: str, dtype: str, categorical: bool | None = None, fill=None) -> Variable:
    kind = np.dtype(dtype).kind
    return Variable(name, dtype, ("y", "x"), (1, 1), kind in "iub" if categorical is None else categorical, fill, False)


# ---------------------------------------------------------------- grids


def emb(spark: SparkSession, sf: str) -> DataFrame:
    found = _read(spark, sf, "embeddings").select(F.col("vec_id").cast("int").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return found.where(~F.isnan("v"))


EMB = "SELECT CAST(vec_id AS INT) AS row, CAST(i AS INT) AS col, embedding[i + 1] AS v FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)"


def ship(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "lineitem")
    place = [F.year("l_shipdate").alias("yr"), F.col("l_suppkey").cast("int").alias("row"), (F.dayofyear("l_shipdate") - 1).alias("col")]
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return items.groupBy(*place).agg(F.max("l_extendedprice").alias("price"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), F.max(flag).alias("flag"))


SHIP = """SELECT CAST(year(l_shipdate) AS INT) AS yr, CAST(l_suppkey AS INT) AS row, CAST(dayofyear(l_shipdate) - 1 AS INT) AS col, max(l_extendedprice) AS price,
CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, max(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS flag FROM lineitem GROUP BY ALL"""


def ev(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type").isNull(), "none").otherwise(F.col("event_type"))
    hour = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600).cast("int")
    rows = _read(spark, sf, "events").groupBy(kind.alias("kind"), F.col("user_id").cast("int").alias("row"), hour.alias("col"))
    return rows.agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"), F.max(F.col("value") > 50).alias("hot"))


EV = """SELECT coalesce(event_type, 'none') AS kind, CAST(user_id AS INT) AS row, CAST(floor((epoch(ts) - 1704067200) / 3600) AS INT) AS col,
max(value) AS peak, count(*) AS n, bool_or(value > 50) AS hot FROM events GROUP BY ALL"""


def geo_raster(spark: SparkSession, sf: str) -> Raster:
    orders = _read(spark, sf, "orders")
    lat, lon = -89.5 + F.col("o_orderkey") % 180, 0.5 + F.col("o_custkey") % 360
    cells = orders.groupBy(lat.cast(DOUBLE).alias("lat"), lon.cast(DOUBLE).alias("lon")).agg(F.max("o_totalprice").alias("total"))
    return Raster(cells, ("lat", "lon"), {"total": {"dtype": "float64", "_FillValue": -9999.0}}, {"lat": {"units": "degrees_north"}, "lon": {"units": "degrees_east"}})


def geo(spark: SparkSession, sf: str) -> Found:
    return detect(geo_raster(spark, sf))


GEO = """SELECT 179 - CAST(o_orderkey % 180 AS INT) AS row, CAST((o_custkey % 360 + 180) % 360 AS INT) AS col, max(o_totalprice) AS total FROM orders GROUP BY ALL"""


# ---------------------------------------------------------------- the SQL of a level


def _value(n: str, method: str, kind: str) -> str:
    p = [f"{n}_{k}" for k in range(4)]
    valid = "(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in p) + ")"
    total = f"(((coalesce(CAST({p[0]} AS DOUBLE), 0) + coalesce(CAST({p[1]} AS DOUBLE), 0)) + coalesce(CAST({p[2]} AS DOUBLE), 0)) + coalesce(CAST({p[3]} AS DOUBLE), 0))"
    votes = ["CASE WHEN {x} IS NULL THEN -1 ELSE {s} END".format(x=x, s=" + ".join(f"coalesce(CAST({y} = {x} AS INT), 0)" for y in p)) for x in p]
    most = f"greatest({', '.join(votes)})"
    return {
        "mean": f"CAST({total} / nullif({valid}, 0) AS FLOAT)" if kind == "f4" else f"{total} / nullif({valid}, 0)" if kind == "f" else f"CAST(round_even({total} / nullif({valid}, 0), 0) AS BIGINT)",
        "min": f"least({', '.join(p)})", "max": f"greatest({', '.join(p)})", "nearest": p[0],
        "mode": f"CASE WHEN {votes[0]} = {most} THEN {p[0]} WHEN {votes[1]} = {most} THEN {p[1]} WHEN {votes[2]} = {most} THEN {p[2]} ELSE {p[3]} END",
        "any": " OR ".join(f"coalesce({x}, false)" for x in p),
    }[method]


def sql_halve(source: str, variables: dict[str, tuple[str, str]], extra: tuple[str, ...] = ()) -> str:
    keys = ", ".join([*extra, "row // 2 AS row", "col // 2 AS col"])
    four = ", ".join(f"max(CASE WHEN (row % 2) * 2 + col % 2 = {k} THEN {n} END) AS {n}_{k}" for n in variables for k in range(4))
    made = ", ".join(f"{_value(n, m, kind)} AS {n}" for n, (m, kind) in variables.items())
    whole = f"SELECT {', '.join([*extra, 'row', 'col'])}, {made} FROM (SELECT {keys}, {four} FROM ({source}) GROUP BY {', '.join([*extra, 'row // 2', 'col // 2'])})"
    return f"SELECT * FROM ({whole}) WHERE {' OR '.join(f'{n} IS NOT NULL' for n in variables)}"


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast(DOUBLE) for n in names})


def _sql_doubles(sql: str, *names: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)}) FROM ({sql})"


def _sql_rounded(sql: str, bits: int) -> str:
    """Floats of a column ``v`` to some bits of their mantissa; zeros stay."""
    step = f"2.0 ** (floor(log2(CASE WHEN v = 0 THEN 1 ELSE abs(CAST(v AS DOUBLE)) END)) - {bits})"
    return f"SELECT row, col, round_even(CAST(v AS DOUBLE) / s, 0) * s AS v FROM (SELECT *, {step} AS s FROM ({sql}))"


V = _variable("v", "float32")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _levels(cells: DataFrame, n: int, chosen, extra=()) -> DataFrame:
    for _ in range(n):
        cells = halve(cells, chosen, extra)
    return cells


for _m in ("mean", "min", "max", "nearest", "mode"):
    register(f"emb_l1_{_m}", lambda s, d, m=_m: _doubles(halve(emb(s, d), [(V, m)]), "v"), _sql_doubles(sql_halve(EMB, {"v": (_m, "f4")}), "v"))
_E2 = sql_halve(sql_halve(EMB, {"v": ("mean", "f4")}), {"v": ("mean", "f4")})
register("emb_l3_mean", lambda s, d: _doubles(_levels(emb(s, d), 3, [(V, "mean")]), "v"), _sql_doubles(sql_halve(_E2, {"v": ("mean", "f4")}), "v"))


def emb_pyramid_all(spark: SparkSession, sf: str) -> DataFrame:
    """Levels 0 to 4 of the embeddings' grid, told apart by ``level``."""
    out, cells = None, emb(spark, sf)
    for k in range(5):
        # a level comes from the stored one before it: nothing is made twice
        cells = stored(cells if k == 0 else halve(cells, [(V, "mean")]), f"emb-{k}")
        one = _doubles(cells, "v").select(F.lit(k).alias("level"), "row", "col", "v")
        out = one if out is None else out.unionByName(one)
    return out


def _all_levels(source: str, n: int, variables: dict[str, tuple[str, str]]) -> str:
    names, sqls = ", ".join(variables), [source]
    for _ in range(n):
        sqls.append(sql_halve(sqls[-1], variables))
    return " UNION ALL ".join(f"SELECT {k} AS level, row, col, {names} FROM ({x})" for k, x in enumerate(sqls))


register("emb_pyramid_all", emb_pyramid_all, _sql_doubles(_all_levels(EMB, 4, {"v": ("mean", "f4")}), "v"))

_PRICE, _QTY, _FLAG = _variable("price", "float64"), _variable("qty", "int64"), _variable("flag", "int32")
_SHIP = [(_PRICE, "mean"), (_QTY, "mean"), (_FLAG, "mode")]
_SHIP_SQL = {"price": ("mean", "f"), "qty": ("mean", "i"), "flag": ("mode", "i")}
register("ship_l1_all", lambda s, d: halve(ship(s, d), _SHIP, ["yr"]), sql_halve(SHIP, _SHIP_SQL, ("yr",)))
for _n, _v, _m, _k in (("price_mean", _PRICE, "mean", "f"), ("int_mean", _QTY, "mean", "i"), ("mode", _FLAG, "mode", "i"), ("int_min", _QTY, "min", "i"), ("int_max", _QTY, "max", "i"), ("nearest", _FLAG, "nearest", "i")):
    register(f"ship_l1_{_n}", lambda s, d, v=_v, m=_m: halve(ship(s, d).select("yr", "row", "col", v.name), [(v, m)], ["yr"]), sql_halve(f"SELECT yr, row, col, {_v.name} FROM ({SHIP})", {_v.name: (_m, _k)}, ("yr",)))
register("ship_l2_all", lambda s, d: _levels(ship(s, d), 2, _SHIP, ["yr"]), sql_halve(sql_halve(SHIP, _SHIP_SQL, ("yr",)), _SHIP_SQL, ("yr",)))


def ship_levels_counts(spark: SparkSession, sf: str) -> DataFrame:
    out, cells = None, ship(spark, sf)
    for k in range(4):
        cells = stored(cells if k == 0 else halve(cells, _SHIP, ["yr"]), f"ship-{k}")
        one = cells.agg(F.count(F.lit(1)).alias("cells")).select(F.lit(k).alias("level"), "cells")
        out = one if out is None else out.unionByName(one)
    return out


_S = [SHIP]
for _ in range(3):
    _S.append(sql_halve(_S[-1], _SHIP_SQL, ("yr",)))
register("ship_levels_counts", ship_levels_counts, " UNION ALL ".join(f"SELECT {k} AS level, count(*) AS cells FROM ({x})" for k, x in enumerate(_S)))

_HOT, _PEAK, _N = _variable("hot", "bool", fill=False), _variable("peak", "float64"), _variable("n", "int64")
register("ev_l1_bool_any", lambda s, d: halve(ev(s, d).select("kind", "row", "col", "hot").where("hot is not null"), [(_HOT, "mode")], ["kind"]), sql_halve(f"SELECT kind, row, col, hot FROM ({EV}) WHERE hot IS NOT NULL", {"hot": ("any", "b")}, ("kind",)))
_EV = {"peak": ("max", "f"), "n": ("max", "i")}
register("ev_l2_max", lambda s, d: _levels(ev(s, d), 2, [(_PEAK, "max"), (_N, "max")], ["kind"]), sql_halve(sql_halve(EV, _EV, ("kind",)), _EV, ("kind",)))


def ev_dense_level(spark: SparkSession, sf: str) -> DataFrame:
    """Level 4 of the event counts without holes."""
    one = ev(spark, sf).groupBy("row", "col").agg(F.sum("n").alias("n"))
    return lookup.dense(_levels(one, 4, [(_N, "max")]), (10, 45)).select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))


_D = f"SELECT row, col, CAST(sum(n) AS BIGINT) AS n FROM ({EV}) GROUP BY row, col"
for _ in range(4):
    _D = sql_halve(_D, {"n": ("max", "i")})
register("ev_dense_level", ev_dense_level, f"SELECT a.row, b.col, coalesce(c.n, 0) AS n FROM (SELECT CAST(unnest(range(0, 10)) AS INT) AS row) a CROSS JOIN (SELECT CAST(unnest(range(0, 45)) AS INT) AS col) b LEFT JOIN ({_D}) c ON a.row = c.row AND b.col = c.col")

register("geo_normalize", lambda s, d: geo(s, d).cells, GEO)


def geo_gap(spark: SparkSession, sf: str) -> DataFrame:
    """All orders in a region over the antimeridian: its 20 columns end up at the two edges of a grid of 360."""
    place = [(-85.5 + 9 * (F.col("o_orderkey") % 20)).cast(DOUBLE).alias("lat"), (170.5 + F.col("o_custkey") % 20).cast(DOUBLE).alias("lon")]
    cells = _read(spark, sf, "orders").groupBy(*place).agg(F.max("o_totalprice").alias("total"))
    return detect(Raster(cells, ("lat", "lon"), {"total": {}})).cells


register("geo_gap", geo_gap, "SELECT 19 - CAST(o_orderkey % 20 AS INT) AS row, CAST(CASE WHEN o_custkey % 20 >= 10 THEN o_custkey % 20 - 10 ELSE o_custkey % 20 + 350 END AS INT) AS col, max(o_totalprice) AS total FROM orders GROUP BY ALL")
_TOTAL = _variable("total", "float64")
register("geo_l1_mean", lambda s, d: halve(geo(s, d).cells, [(_TOTAL, "mean")]), sql_halve(GEO, {"total": ("mean", "f")}))

_LAT = "SELECT DISTINCT -89.5 + o_orderkey % 180 AS v FROM orders"


def _axis(spark: SparkSession, sf: str) -> np.ndarray:
    return axis_values(geo_raster(spark, sf).df, "lat")


register("grid_step", lambda s, d: s.createDataFrame([(round(grid_step(_axis(s, d)), 9),)], "step double"), f"SELECT round(regr_slope(v, i), 9) AS step FROM (SELECT CAST(v AS DOUBLE) AS v, row_number() OVER (ORDER BY v) - 1 AS i FROM ({_LAT}))")
register("grid_regular", lambda s, d: s.createDataFrame([(check_regular("lat", _axis(s, d), 1.0), len(_axis(s, d)))], "off double, n long"), f"SELECT max(abs(v - (-89.5 + i))) AS off, count(*) AS n FROM (SELECT CAST(v AS DOUBLE) AS v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS i FROM ({_LAT}))")


def _plan_grid(spark: SparkSession, sf: str):
    shape = _read(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("ny"), F.max(F.size("embedding")).alias("nx")).first()
    ny, nx = int(shape.ny) * 8, int(shape.nx) * 40
    v = Variable("v", "float32", ("y", "x"), (ny, nx), False, float("nan"), False)
    return build_plan(Grid("x", "y", parse("EPSG:3031"), (ny, nx), (30.0, 0.0, 0.0, 0.0, -30.0, 0.0), (v,), ()), tile_size=256)


_P = """WITH RECURSIVE s AS (SELECT CAST((max(vec_id) + 1) * 8 AS INT) AS ny, CAST(max(len(embedding)) * 40 AS INT) AS nx FROM embeddings),
p(level, ny, nx) AS (SELECT 0, ny, nx FROM s UNION ALL SELECT level + 1, CAST((ny + 1) // 2 AS INT), CAST((nx + 1) // 2 AS INT) FROM p WHERE greatest(ny, nx) > 256)"""
register("plan_levels", lambda s, d: _plan_grid(s, d).to_df(s).select("level", "ny", "nx", "dx", "dy"), _P + " SELECT level, ny, nx, 30.0::DOUBLE * 2 ** level AS dx, -30.0::DOUBLE * 2 ** level AS dy FROM p")
register("plan_nbytes", lambda s, d: _plan_grid(s, d).to_df(s).select("level", "nbytes"), _P + " SELECT level, CAST(ny AS BIGINT) * nx * 4 AS nbytes FROM p")
register("level_bbox", lambda s, d: _plan_grid(s, d).to_df(s).select("level", "west", "south", "east", "north"), _P + " SELECT level, 0.0::DOUBLE AS west, -30.0::DOUBLE * 2 ** level * ny AS south, 30.0::DOUBLE * 2 ** level * nx AS east, 0.0::DOUBLE AS north FROM p")
register("plan_chunks", lambda s, d: _plan_grid(s, d).to_df(s).select("level", F.col("chunks")[0].alias("cy"), F.col("chunks")[1].alias("cx"), F.coalesce(F.col("shards")[0], F.lit(0)).alias("sy"), F.coalesce(F.col("shards")[1], F.lit(0)).alias("sx")), _P + """,
c AS (SELECT level, ny, nx, least(ny, 256) AS cy, least(nx, 256) AS cx FROM p), k AS (SELECT *, CAST(ceil(ny / cy) * ceil(nx / cx) AS INT) AS n, CAST(ceil(ny / cy) AS INT) * cy AS wy, CAST(ceil(nx / cx) AS INT) * cx AS wx FROM c)
SELECT level, cy, cx, CASE WHEN n <= 4 THEN 0 ELSE least(4096, wy) END AS sy, CASE WHEN n <= 4 THEN 0 ELSE least(4096, wx) END AS sx FROM k""")

register("stats_limits", lambda s, d: stats.limits(emb(s, d), "v").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")), f"SELECT round(quantile_cont(CAST(v AS DOUBLE), 0.02), 6) AS lo, round(quantile_cont(CAST(v AS DOUBLE), 0.98), 6) AS hi FROM ({EMB})")
register("stats_categories", lambda s, d: stats.categories(ship(s, d), "flag").select(F.col("code").cast("long"), F.col("value").cast("long"), "color"), f"SELECT row_number() OVER (ORDER BY flag) - 1 AS code, CAST(flag AS BIGINT) AS value, ['{"', '".join(display.PALETTE)}'][(row_number() OVER (ORDER BY flag) - 1) % 10 + 1] AS color FROM (SELECT DISTINCT flag FROM ({SHIP})) ORDER BY flag LIMIT 20")
register("stats_auto_range", lambda s, d: stats.auto_range(emb(s, d), "v").select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")), f"""SELECT round(CASE WHEN around THEN -m ELSE lo END, 6) AS lo, round(CASE WHEN around THEN m WHEN hi <= lo THEN lo + 1 ELSE hi END, 6) AS hi FROM (SELECT *, greatest(abs(lo), abs(hi)) AS m, lo < 0 AND hi > 0 AND least(abs(lo), abs(hi)) / greatest(abs(lo), abs(hi)) >= 0.5 AS around
FROM (SELECT quantile_cont(CAST(v AS DOUBLE), 0.02) AS lo, quantile_cont(CAST(v AS DOUBLE), 0.98) AS hi FROM ({EMB})))""")
register("stats_extent", lambda s, d: stats.extent(ship(s, d), "price"), f"SELECT min(price) AS lo, CASE WHEN max(price) > min(price) THEN max(price) ELSE min(price) + 1 END AS hi FROM ({SHIP})")
register("point_lookup", lambda s, d: lookup.point(geo(s, d).cells, geo(s, d).grid.transform, -20.25, 42.25), f"SELECT * FROM ({GEO}) WHERE row = 47 AND col = 159")
register("window_read", lambda s, d: lookup.window(geo(s, d).cells, geo(s, d).grid.transform, (180, 360), (-30.0, 10.0, 20.0, 40.0)), f"SELECT * FROM ({GEO}) WHERE row BETWEEN 50 AND 79 AND col BETWEEN 150 AND 199")


def mask_fill(spark: SparkSession, sf: str) -> DataFrame:
    """A declared fill value becomes missing data: line numbers of 1 in a small grid."""
    rows = _read(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).cast(DOUBLE).alias("y"), (F.col("l_partkey") % 30).cast(DOUBLE).alias("x")).agg(F.min("l_linenumber").alias("first"))
    found = detect(Raster(rows, ("y", "x"), {"first": {"dtype": "int32", "_FillValue": 1}}), crs="EPSG:3031")
    return found.cells.select("row", "col", F.coalesce("first", F.lit(-1)).alias("first"))


register("mask_fill", mask_fill, """WITH g AS (SELECT l_suppkey % 20 AS y, l_partkey % 30 AS x, min(l_linenumber) AS first FROM lineitem GROUP BY ALL)
SELECT CAST((SELECT max(y) FROM g) - y AS INT) AS row, CAST(x - (SELECT min(x) FROM g) AS INT) AS col, CASE WHEN first = 1 THEN -1 ELSE first END AS first FROM g""")


def sentinel_fill(spark: SparkSession, sf: str) -> DataFrame:
    """What stands for missing data in each integer type."""
    from .grid import sentinel

    return spark.createDataFrame([(t, sentinel(t)) for t in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32")], "dtype string, fill long")


register("sentinel_fill", sentinel_fill, "SELECT * FROM (VALUES ('int8', -128::BIGINT), ('int16', -32768), ('int32', -2147483648), ('int64', -9223372036854775808), ('uint8', 255), ('uint16', 65535), ('uint32', 4294967295)) AS t(dtype, fill)")
register("validate_levels", lambda s, d: _missing_levels(s, d), f"SELECT kind, row // 2 AS row, col // 2 AS col FROM ({EV}) WHERE hot IS NOT NULL EXCEPT SELECT kind, row, col FROM ({sql_halve(f'SELECT kind, row, col, hot FROM ({EV}) WHERE hot AND row % 2 = 0', {'hot': ('any', 'b')}, ('kind',))})")


def _missing_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks that a level should have and a faulty one lacks: the set difference that a check of two levels takes."""
    cells = ev(spark, sf).where("hot is not null")
    faulty = halve(cells.where("hot and row % 2 = 0").select("kind", "row", "col", "hot"), [(_HOT, "mode")], ["kind"])
    return missing_blocks(cells, faulty, ["kind"])


register("keepbits_emb", lambda s, d: _doubles(quantize(emb(s, d), {"v": 8}, {"v": "float32"}), "v"), _sql_rounded(EMB, 8))
register("iso_labels", lambda s, d: _read(s, d, "events").select("event_id", columns.iso_label(F.col("ts")).alias("label"), columns.iso_time(F.col("ts")).alias("iso")), "SELECT event_id, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T00:00:00', '') AS label, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
register("palette_codes", lambda s, d: _read(s, d, "nation").select("n_nationkey", columns.palette(F.col("n_nationkey")).alias("color")), f"SELECT n_nationkey, ['{"', '".join(display.PALETTE)}'][n_nationkey % 10 + 1] AS color FROM nation")


def colorize(spark: SparkSession, sf: str) -> DataFrame:
    """The gray of each embedding cell on a ramp of two stops over -0.5 to 0.5."""
    gray = columns.ramp(F.col("v"), -0.5, 0.5, [(0, 0, 0), (255, 255, 255)])
    return emb(spark, sf).select("row", "col", gray[0].alias("gray"))


register("colorize", colorize, f"SELECT row, col, CAST(round_even(greatest(0.0, least(1.0, CAST(v AS DOUBLE) + 0.5)) * 255, 0) AS INT) AS gray FROM ({EMB})")
register("frame_values", lambda s, d: lookup.strided(lookup.frame(ship(s, d), {"yr": 1996}), 2).select("row", "col", "price"), f"SELECT row, col, price FROM ({SHIP}) WHERE yr = 1996 AND row % 2 = 0 AND col % 2 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries_library  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
