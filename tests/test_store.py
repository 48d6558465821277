"""Pyramids end to end: written, read, checked, exported."""

import json
import math

import numpy as np
import pytest

from tessera import cli
from tessera.grid import Raster
from tessera.operators import lookup
from tessera.operators.quantize import bitround
from tessera.sources import blosc, zarr
from tessera.store import Files, group_path, open_pyramid, read_config, render_html, to_pyramid
from tessera.validate import is_valid, to_df, validate


def raster(spark, ny=40, nx=36, times=2):
    rows = [(t, float(-y), float(x), float(t * 10**6 + y * 1000 + x) if (y + x) % 7 else math.nan, (y * x) % 3 - 1) for t in range(times) for y in range(ny) for x in range(nx)]
    df = spark.createDataFrame(rows, "time int, y double, x double, melt float, mask int")
    return Raster(df, ("time", "y", "x"), {"melt": {"dtype": "float32", "units": "m yr-1", "long_name": r"$\Delta$ melt_{2}"}, "mask": {"dtype": "int8", "_FillValue": -1, "flag_values": [0, 1]}}, attrs={"title": "test", "history": "old"})


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pyramid") / "p")
    return to_pyramid(raster(spark), path, crs=3031, tile_size=8)


def test_levels_and_report(spark, made):
    assert is_valid(made.validation), made.validation
    assert set(made.timings) == {*(f"level_{k}" for k in range(len(made.plan.levels))), "total"}
    p = open_pyramid(spark, made.path)
    assert p.n_levels == 4 and p.plan.methods == made.plan.methods == {"melt": "mean", "mask": "mode"}
    assert p.plan.levels == made.plan.levels and repr(p.plan) == repr(made.plan)
    assert p.levels().select("level").distinct().count() == 4
    one = {(r.row, r.col): r.melt for r in p.level(1).where("time = 1").collect()}
    four = [float(10**6 + y * 1000 + x) for y in (0, 1) for x in (2, 3) if (y + x) % 7]
    assert math.isclose(one[0, 1], np.mean(np.array(four, np.float32)), rel_tol=1e-6)


def test_config(spark, made):
    c = read_config(spark, made.path)
    melt, mask = c["variables"]
    assert (melt["long_name"], melt["units"]) == ("Δmelt₂", "m yr⁻¹") and mask["categories"][0] == {"value": 0, "color": "#1f77b4"}
    assert 4 <= len(melt["ticks"]) <= 6 and not c["global"] and c["dims"][0]["labels"] == [0, 1]
    assert "<\\/script>" in render_html({"title": "a<b", "x": "</script>"}, "<title>{{title}}</title>{{config}}")


def test_overwriting(spark, made, tmp_path):
    with pytest.raises(FileExistsError):
        to_pyramid(raster(spark), made.path, crs=3031)
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine/keep.txt").write_text("x")
    with pytest.raises(FileExistsError):
        to_pyramid(raster(spark), str(tmp_path / "mine"), crs=3031, overwrite=True)
    again = to_pyramid(raster(spark, 10, 10, 1), str(tmp_path / "two"), group="maps/a", crs=3031, tile_size=8)
    assert again.path.endswith("two/maps/a") and is_valid(validate(spark, str(tmp_path / "two"), "maps/a"))
    for bad in ("a/../b", "a//b", "."):
        with pytest.raises(ValueError):
            group_path("p", bad)


def test_methods_of_a_raster(spark, tmp_path):
    r = raster(spark, 10, 10, 1)
    assert len(r.plan(crs=3031, tile_size=8).levels) == 2
    assert is_valid(r.to_pyramid(str(tmp_path / "p"), crs=3031, tile_size=8).validation)


def test_options_of_a_pyramid(spark, tmp_path):
    from tessera.viewer import check_store

    path = str(tmp_path / "p")
    made = to_pyramid(raster(spark, 20, 20, 1), path, crs=3031, tile_size=8, encoding_preset="zstd", compression_level=5, preview=str(tmp_path / "page.html"), storage_options={"region": "eu"})
    assert check_store(f"{path}/zarr") and "zarr" in made.timings and "Δmelt₂" in json.loads(f'"{(tmp_path / "page.html").read_text().split(chr(34) + "long_name" + chr(34) + ": " + chr(34))[1].split(chr(34))[0]}"')
    assert to_pyramid(raster(spark, 20, 20, 1), path, crs=3031, tile_size=8, overwrite=True).path == path and not (tmp_path / "p/zarr").exists()
    for bad, error in (({"encoding_preset": "fast"}, ValueError), ({"storage_options": {"x": 1}}, TypeError)):
        with pytest.raises(error):
            to_pyramid(raster(spark, 20, 20, 1), str(tmp_path / "q"), crs=3031, **bad)
    with pytest.raises(TypeError):
        to_pyramid(raster(spark, 20, 20, 1), tmp_path / "q", crs=3031)
    doc = json.loads((tmp_path / "p/_pyramid.json").read_text())
    for damage in ({"attrs": 7}, {"levels": 3}, {"attrs": doc["attrs"] | {"multiscales": {"layout": [1, {"asset": "0"}]}}}, {"grid": None}):
        Files(spark).write(f"{path}/_pyramid.json", json.dumps(doc | damage))
        assert not is_valid(validate(spark, path, plan=made.plan, cells=True))


def test_errors_come_before_writing(spark, tmp_path):
    with pytest.raises(ValueError):
        to_pyramid(raster(spark), str(tmp_path / "no"), crs=3031, keepbits={"mask": 3})
    assert not (tmp_path / "no").exists()


def test_checks_find_faults(spark, tmp_path):
    path = str(tmp_path / "p")
    made = to_pyramid(raster(spark, 20, 20, 1), path, crs=3031, tile_size=8)
    files, doc = Files(spark), json.loads((tmp_path / "p/_pyramid.json").read_text())
    doc["attrs"]["multiscales"]["layout"][1]["derived_from"] = "7"
    doc["attrs"]["zarr_conventions"] = doc["attrs"]["zarr_conventions"][:2]
    doc["levels"]["1"]["attrs"]["spatial:shape"] = [3, 3]
    del doc["levels"]["2"]["attrs"]["spatial:transform"]
    files.write(f"{path}/_pyramid.json", json.dumps(doc))
    report = validate(spark, path)
    assert not is_valid(report) and all(report[k] for k in ("zarr_conventions", "multiscales", "spatial"))
    assert to_df(spark, report).count() == sum(map(len, report.values()))
    files.delete(f"{path}/level=2")
    assert "level 2 doesn't exist" in validate(spark, path, plan=None)["structure"]
    with pytest.raises(FileNotFoundError):
        validate(spark, str(tmp_path / "nothing"))
    assert made.plan.levels


@pytest.mark.parametrize("dtype,bits", [("float32", 7), ("float64", 20)])
def test_bit_rounding(dtype, bits):
    v = np.random.default_rng(1).normal(size=1000).astype(dtype)
    v[:3] = [np.nan, np.inf, 0]
    r = bitround(v, bits)
    real = slice(3, None)
    assert np.abs(r[real] / v[real] - 1).max() <= 2.0 ** -(bits + 1)
    kind, mantissa = (np.uint32, 23) if dtype == "float32" else (np.uint64, 52)
    assert not (r[real].view(kind) & kind((1 << (mantissa - bits)) - 1)).any()
    assert np.isnan(r[0]) and np.isinf(r[1]) and r[2] == 0
    assert (bitround(v[real], mantissa) == v[real]).all()


def test_rounding_at_every_level(spark, tmp_path):
    made = to_pyramid(raster(spark, 16, 16, 1), str(tmp_path / "b"), crs=3031, tile_size=8, keepbits=5)
    for k in range(2):
        v = np.array([r.melt for r in open_pyramid(spark, made.path).level(k).where("melt is not null").collect()], np.float32)
        assert not (v.view(np.uint32) & np.uint32((1 << 18) - 1)).any()


@pytest.mark.parametrize("preset", ["web", "zstd"])
def test_zarr_round_trip(spark, made, tmp_path, preset):
    root = str(tmp_path / "out.zarr")
    p = open_pyramid(spark, made.path)
    zarr.export(p, root, preset)
    doc = json.loads((tmp_path / "out.zarr/zarr.json").read_text())
    assert doc["consolidated_metadata"]["metadata"]["0/melt"]["codecs"][0]["name"] == "sharding_indexed"
    for name in ("melt", "mask"):
        want = {(r.time, r.row, r.col): r[name] for r in p.level(0).where(f"{name} is not null").collect()}
        got = {(r.time, r.y, r.x): r[name] for r in zarr.read_array(spark, f"{root}/0/{name}", name).collect()}
        assert got == want
    again = zarr.open_raster(spark, f"{root}/1", ["melt"])
    assert again.dims == ("time", "y", "x") and again.df.agg({"y": "max"}).first()[0] == -0.5
    with pytest.raises(ValueError):
        zarr.open_raster(spark, f"{root}/1", ["nope"])
    spark.dataSource.register(zarr.ZarrSource)
    assert spark.read.format("zarr").option("column", "mask").load(f"{root}/0/mask").count() == len(want)
    for bad in (("fast", 3), ("web", 10), ("zstd", True)):
        with pytest.raises(ValueError):
            zarr.export(p, root, *bad)


@pytest.mark.parametrize("bits", [True, False])
def test_blosc_frames(bits):
    for n, dtype in ((4096, "float32"), (1001, "float64"), (64, "uint8"), (0, "int16")):
        data = np.arange(n).astype(dtype).tobytes()
        for level in (0, 3, 9):
            assert blosc.decompress(blosc.compress(data, np.dtype(dtype).itemsize, level, bits)) == data
    assert blosc.bitshuffle(bytes([1, 0, 0, 0, 0, 0, 0, 128]), 1) == bytes([1, 0, 0, 0, 0, 0, 0, 128])


def test_checksum():
    assert zarr.crc32c(b"123456789") == 0xE3069283


def test_lookup(spark, made):
    p = open_pyramid(spark, made.path)
    at = p.plan.levels[0]
    assert lookup.cell_at(at.transform, 3.2, -5.4) == (5, 3)
    assert {(r.row, r.col) for r in lookup.point(p.level(0), at.transform, 3.2, -5.4).collect()} == {(5, 3)}
    assert lookup.sample([(p.level(0), at.transform, at.shape)], 999, 0) is None
    box = lookup.window(p.level(0), at.transform, at.shape, (2.0, -4.0, 5.0, -1.0)).where("time = 0")
    assert {r.row for r in box.collect()} == {1, 2, 3, 4} - {0} and box.agg({"col": "max"}).first()[0] <= 5
    assert lookup.dense(p.level(3).drop("time"), p.plan.levels[3].shape).count() >= math.prod(p.plan.levels[3].shape)


def test_command_line(spark, tmp_path, capsys):
    raster(spark, 20, 20, 1).df.write.parquet(str(tmp_path / "in"))
    assert cli.main(["plan", str(tmp_path / "in"), "--crs", "EPSG:3031", "--tile-size", "8"]) == 0
    assert "levels" in capsys.readouterr().out
    assert cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "o"), "--crs", "EPSG:3031", "--resampling", "melt=max", "--fill-value", "mask=-1", "--tile-size", "8"]) == 0
    assert cli.main(["validate", str(tmp_path / "o")]) == 0
    assert cli.main(["preview", str(tmp_path / "o")]) == 0
    assert cli.main(["preview", str(tmp_path / "o"), "--html", str(tmp_path / "o.html")]) == 0 and "<title>o</title>" in (tmp_path / "o.html").read_text()
    assert cli.main(["convert", str(tmp_path / "in"), str(tmp_path / "o"), "--crs", "EPSG:3031"]) == 2
    assert cli.main(["validate", str(tmp_path / "none")]) == 2
    assert cli.main(["plan", str(tmp_path / "in"), "--var", "nope"]) == 2
    assert cli.main(["version"]) == 0 and cli.main([]) == 2
