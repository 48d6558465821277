"""Finding a grid, canonical cells, fill values."""

import logging
import math

import numpy as np
import pytest

from tessera.crs import Crs, parse
from tessera.grid import GridError, Raster, check_regular, declared_fill, detect, effective_fill, grid_step, sentinel


def raster(spark, ys, xs, names=("y", "x"), attrs=None, value=lambda r, c: float(r * 1000 + c), **more):
    rows = [(float(y), float(x), value(r, c)) for r, y in enumerate(ys) for c, x in enumerate(xs)]
    df = spark.createDataFrame(rows, f"{names[0]} double, {names[1]} double, v double")
    return Raster(df, names, {"v": {"dtype": "float64"} | (attrs or {})}, **more)


def values(found):
    return {(r.row, r.col): r.v for r in found.cells.collect()}


def test_north_up(spark):
    found = detect(raster(spark, [10.0, 20.0, 30.0], [0.0, 5.0]), crs="EPSG:32632")
    assert found.grid.shape == (3, 2) and found.grid.transform == (5.0, 0.0, -2.5, 0.0, -10.0, 35.0)
    assert values(found)[2, 1] == 1.0 and values(found)[0, 0] == 2000.0  # the first of the source is the southernmost
    assert found.grid.bbox == (-2.5, 5.0, 7.5, 35.0)


def test_longitudes_wrap(spark):
    xs = np.arange(0.5, 360, 30)
    found = detect(raster(spark, [0.0, 1.0], xs, ("lat", "lon")))
    assert found.grid.crs.code == "EPSG:4326" and found.xs[0] == -179.5 and found.xs.min() >= -180
    got = values(found)
    assert [got[1, c] for c in range(12)] == [float(c) for c in (*range(6, 12), *range(6))]


def test_region_over_the_antimeridian(spark, caplog):
    with caplog.at_level(logging.WARNING, "tessera"):
        found = detect(raster(spark, [0.0, 1.0], np.arange(170.5, 190), ("lat", "lon")))
    assert found.grid.shape == (2, 360) and "antimeridian" in caplog.text
    assert {c for _, c in values(found)} == {*range(10), *range(350, 360)}
    assert values(found)[1, 0] == 10.0 and values(found)[1, 350] == 0.0


def test_all_beyond_180_only_shift(spark):
    found = detect(raster(spark, [0.0, 1.0], np.arange(200.5, 210), ("lat", "lon")))
    assert found.grid.shape == (2, 10) and found.xs[0] == -159.5


def test_axes_by_attributes(spark):
    r = raster(spark, [1.0, 2.0], [1.0, 2.0], ("a", "b"), coords={"a": {"axis": "Y"}, "b": {"axis": "X"}})
    assert (detect(r, crs=3031).grid.y, detect(r, crs=3031).grid.x) == ("a", "b")
    with pytest.raises(GridError):
        detect(raster(spark, [1.0, 2.0], [1.0, 2.0], ("a", "b")))


def test_crs_is_needed(spark):
    with pytest.raises(GridError):
        detect(raster(spark, [0.0, 4e4], [0.0, 4e4]))
    r = raster(spark, [0.0, 4e4], [0.0, 4e4], attrs={"grid_mapping": "m"}, scalars={"m": {"grid_mapping_name": "polar_stereographic", "standard_parallel": -71.0, "straight_vertical_longitude_from_pole": 0.0}})
    assert detect(r).grid.crs.code == "EPSG:3031"


def test_irregular_and_single(spark):
    with pytest.raises(GridError):
        detect(raster(spark, [0.0, 1.0, 3.0], [0.0, 1.0]), crs=3031)
    with pytest.raises(GridError):
        detect(raster(spark, [0.0], [0.0, 1.0]), crs=3031)
    assert detect(raster(spark, [5.0], [0.0, 1.0], attrs=None, coords={"y": {"res": 2.0}}), crs=3031).grid.transform[4] == -2.0


def test_steps():
    assert grid_step(np.array([1.0, 3.0])) == 2.0 and math.isclose(grid_step(np.linspace(0, 1, 11)), 0.1)
    x = np.linspace(0, 3600, 3601, dtype=np.float32) * np.float32(0.1)
    check_regular("x", x, grid_step(x))
    with pytest.raises(GridError):
        check_regular("x", np.zeros(3), 0.0)


def test_fill_values():
    assert (sentinel("int16"), sentinel("uint8"), sentinel("int8", [-128])) == (-32768, 255, 127)
    with pytest.raises(GridError):
        sentinel("uint8", [0, 255])
    assert declared_fill("v", {"_FillValue": -1, "missing_value": -2}, "int16") == (-1, True)
    assert declared_fill("v", {"encoding": {"missing_value": -2}}, "int16") == (-2, True)
    assert declared_fill("v", {"encoding": {"fill_value": 0}}, "int16") == (None, False)
    assert declared_fill("v", {"_FillValue": -1}, "int16", {"v": 5}) == (5, True)
    assert math.isnan(effective_fill("float32", -9999)) and effective_fill("bool", None) is False
    for dtype, bad in (("int16", 1.5), ("int16", 40000), ("bool", 1), ("float32", "a"), ("float32", True)):
        with pytest.raises(ValueError):
            declared_fill("v", {}, dtype, {"v": bad})


def test_fills_become_nulls(spark):
    r = raster(spark, [0.0, 1.0], [0.0, 1.0], attrs={"_FillValue": -9.0}, value=lambda r, c: -9.0 if r == c else math.nan if c else 3.0)
    assert {k: v for k, v in values(detect(r, crs=3031)).items()} == {(1, 0): None, (1, 1): None, (0, 0): 3.0, (0, 1): None}
    with pytest.raises(ValueError):
        detect(r, crs=3031, fill_values={"w": 1})


def test_crs_registry():
    assert parse("epsg:4326").geographic and not parse(32733).geographic
    assert parse(parse(3413).wkt).code == "EPSG:3413"
    for bad in ("EPSG:1", "nonsense"):
        with pytest.raises(ValueError):
            parse(bad)


@pytest.mark.parametrize("code", [4326, 4258, 4269, 3857, 3031, 3413, 3995, 32661, 32761, 6931, 6932, 6933, 3035, 3034, 5070, 3338, 32632, 32733, 25832, 26910])
def test_registry_texts_close_their_brackets_and_name_their_code(code):
    c = parse(code)
    assert parse(c.wkt) == Crs(c.code, c.wkt, c.geographic) and c.code == f"EPSG:{code}" and c.geographic == (code in (4326, 4258, 4269))
    assert c.wkt.count("[") == c.wkt.count("]") and c.wkt.count('"') % 2 == 0 and c.proj4.startswith("+proj=")
    assert parse(f"epsg:{code}") == c
