"""GeoTIFF and classic NetCDF files, written here byte by byte."""

import struct
import zlib

import numpy as np
import pytest

from tessera import cli
from tessera.grid import GridError, detect
from tessera.sources import geotiff, netcdf


def lzw(data):
    out, held, bits, width, table, word = bytearray(), 0, 0, 9, {}, b""

    def put(code):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def fresh():
        return {bytes([b]): b for b in range(256)} | {b"clear": 256, b"end!!": 257}

    table = fresh()
    put(256)
    for b in data:
        longer = word + bytes([b])
        if longer in table and longer not in (b"clear", b"end!!"):
            word = longer
            continue
        put(table[word])
        table[longer] = len(table)
        width = max(9, len(table).bit_length())
        if len(table) == 4094:
            put(256)
            table, width = fresh(), 9
        word = bytes([b])
    if word:
        put(table[word])
        table[None] = len(table)
        width = min(12, max(9, len(table).bit_length()))
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def tiff(path, values, order="<", tile=None, rows=7, compression=1, predictor=1, planar=False, nodata=None, code=32632, again=False):
    """``values``: band, row, column."""
    bands, ny, nx = values.shape
    kind = values.dtype.newbyteorder(order)
    h, w = tile or (rows, nx)
    blocks = []
    for group in [[b] for b in range(bands)] if planar else [list(range(bands))]:
        for y in range(0, ny, h):
            for x in range(0, nx, w):
                part = values[group, y : y + h, x : x + w].transpose(1, 2, 0)
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
                raw = np.ascontiguousarray(part.astype(kind)).tobytes()
                if predictor == 3:
                    planes = np.frombuffer(np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).tobytes(), np.uint8).reshape(part.shape[0], -1, kind.itemsize).transpose(0, 2, 1).reshape(part.shape[0], -1, len(group))
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
                blocks.append({1: lambda r: r, 5: lzw, 8: zlib.compress}[compression](raw))
    body, offsets = bytearray(b"II*\0" if order == "<" else b"MM\0*") + b"\0" * 4, []
    for b in blocks:
        offsets.append(len(body))
        body += b + b"\0" * (len(b) % 2)
    tags = {256: ("I", [nx]), 257: ("I", [ny]), 258: ("H", [kind.itemsize * 8] * bands), 259: ("H", [compression]), 277: ("H", [bands]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[kind.kind]] * bands)}
    tags |= {322: ("I", [w]), 323: ("I", [h]), 324: ("I", offsets), 325: ("I", [len(b) for b in blocks])} if tile else {278: ("I", [h]), 273: ("I", offsets), 279: ("I", [len(b) for b in blocks])}
    tags |= {33550: ("d", [30.0, 30.0, 0.0]), 33922: ("d", [0, 0, 0, 1000.0, 5000.0, 0]), 34735: ("H", [1, 1, 0, 2, 1025, 0, 1, 1, 3072, 0, 1, code])}
    if nodata is not None:
        tags[42113] = ("c", nodata.encode() + b"\0")
    number = {"H": 3, "I": 4, "d": 12, "c": 2}
    for last in ((False, True) if again else (True,)):
        entries = []
        for tag, (k, v) in sorted(tags.items()):
            raw = bytes(v) if k == "c" else struct.pack(f"{order}{len(v)}{k}", *v)
            if len(raw) > 4:
                entries.append(struct.pack(order + "HHII", tag, number[k], len(v), len(body)))
                body += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack(order + "HHI", tag, number[k], len(v)) + raw.ljust(4, b"\0"))
        at = len(body)
        link = (4 if body[4:8] == b"\0" * 4 else at_last)
        body[link : link + 4] = struct.pack(order + "I", at)
        body += struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0" * 4
        at_last = len(body) - 4
        if last:
            break
    path.write_bytes(body)
    return str(path)


CASES = [
    ("float32", {}), ("int16", {"order": ">", "compression": 8, "predictor": 2}), ("uint8", {"compression": 5, "predictor": 2, "tile": (16, 16)}), ("float32", {"compression": 8, "predictor": 3, "tile": (16, 32)}),
    ("float64", {"order": ">", "compression": 5, "predictor": 3}), ("int32", {"tile": (16, 16), "planar": True}), ("uint16", {"compression": 5}),
]


@pytest.mark.parametrize("dtype,how", CASES)
@pytest.mark.parametrize("bands", [1, 3])
def test_images_come_back(tmp_path, dtype, how, bands):
    rng = np.random.default_rng(1)
    values = (rng.normal(size=(bands, 45, 37)) * 50).astype(dtype) if dtype[0] == "f" else rng.integers(0, 200, (bands, 45, 37)).astype(dtype)
    image = geotiff.Tiff.open(tiff(tmp_path / "a.tif", values, **how))
    got = np.zeros_like(values)
    for n in range(len(image.offsets)):
        (b, y, x), part = image.place(n), image.read(n)
        got[b : b + part.shape[0], y : y + part.shape[1], x : x + part.shape[2]] = part
    assert (got == values).all() and image.shape == values.shape and (image.xs[0], image.ys[0], image.crs) == (1015.0, 4985.0, "EPSG:32632")


def test_long_lzw():
    rng = np.random.default_rng(2)
    for data in (bytes(rng.integers(0, 4, 60_000).astype(np.uint8)), b"a" * 30_000, bytes(rng.integers(0, 256, 9000).astype(np.uint8)), b""):
        assert geotiff.unpack_lzw(lzw(data)) == data


def test_a_geotiff_as_a_raster(spark, tmp_path, capsys):
    values = np.arange(2 * 20 * 30).reshape(2, 20, 30).astype("float32")
    values[0, 3, 4] = -9999
    path = tiff(tmp_path / "a.tif", values, nodata="-9999", compression=8)
    found = detect(geotiff.open_geotiff(spark, path))
    assert found.grid.crs.code == "EPSG:32632" and found.grid.shape == (20, 30) and found.grid.transform == (30.0, 0.0, 1000.0, 0.0, -30.0, 5000.0)
    cells = {(r.band, r.row, r.col): r.band_data for r in found.cells.collect()}
    assert cells[1, 3, 4] is None and all(v == values[b - 1, r, c] for (b, r, c), v in cells.items() if v is not None) and len(cells) == values.size
    assert cli.main(["plan", path, "--tile-size", "8"]) == 0 and "EPSG:32632" in capsys.readouterr().out
    with pytest.raises(GridError):
        geotiff.Tiff.open(tiff(tmp_path / "b.tif", values, again=True))
    (tmp_path / "c.tif").write_bytes(b"no image at all!")
    assert cli.main(["plan", str(tmp_path / "c.tif")]) == 2


def classic(path, version=1, records=3):
    """time (unlimited) × lat × lon: ``melt`` float and ``n`` short by record, ``mask`` without time."""
    wide, far = ">q" if version == 5 else ">i", ">i" if version == 1 else ">q"
    number = lambda n: struct.pack(wide, n)
    padded = lambda raw: raw + b"\0" * (-len(raw) % 4)
    text = lambda s: number(len(s)) + padded(s.encode())
    attr = lambda name, value: text(name) + (struct.pack(">i", 2) + text(value) if isinstance(value, str) else struct.pack(">i", 5) + number(1) + struct.pack(">f", value))
    attrs = lambda own: (struct.pack(">i", 12 if own else 0) + number(len(own)) + b"".join(attr(k, v) for k, v in own.items()))
    dims = {"time": 0, "lat": 5, "lon": 7}
    melt = np.arange(records * 35).reshape(records, 5, 7).astype(">f4")
    n = (np.arange(records * 35) % 9).reshape(records, 5, 7).astype(">i2")
    held = [("lat", ["lat"], 6, {"units": "degrees_north"}, np.linspace(40, 48, 5).astype(">f8")), ("lon", ["lon"], 6, {"units": "degrees_east"}, np.linspace(10, 22, 7).astype(">f8")), ("mask", ["lat", "lon"], 4, {}, np.arange(35).reshape(5, 7).astype(">i4"))]
    kept = [("time", ["time"], 6, {}, np.arange(records).astype(">f8")), ("melt", ["time", "lat", "lon"], 5, {"_FillValue": 4.0}, melt), ("n", ["time", "lat", "lon"], 3, {}, n)]

    def header(places):
        out = b"CDF" + bytes([version]) + number(records) + struct.pack(">i", 10) + number(3) + b"".join(text(d) + number(s) for d, s in dims.items()) + attrs({"title": "small"})
        out += struct.pack(">i", 11) + number(len(held) + len(kept))
        for name, own, kind, more, values in held + kept:
            size = values.nbytes // (records if (name, own, kind) in [(k[0], k[1], k[2]) for k in kept] else 1)
            out += text(name) + number(len(own)) + b"".join(number(list(dims).index(d)) for d in own) + attrs(more) + struct.pack(">i", kind) + number(-(-size // 4) * 4) + struct.pack(far, places.get(name, 0))
        return out

    at, places, body = len(header({})), {}, b""
    for name, *_, values in held:
        places[name] = at + len(body)
        body += padded(values.tobytes())
    for name, *_, values in kept:
        places[name] = at + len(body) + sum(-(-v.nbytes // records // 4) * 4 for m, *_, v in kept[: [k[0] for k in kept].index(name)])
    for r in range(records):
        for *_, values in kept:
            body += padded(values[r : r + 1].tobytes())
    path.write_bytes(header(places) + body)
    return str(path), melt, n


@pytest.mark.parametrize("version", [1, 2, 5])
def test_classic_netcdf(spark, tmp_path, version):
    path, melt, n = classic(tmp_path / "a.nc", version)
    head = netcdf.Header(path)
    assert head.attrs == {"title": "small"} and head.sizes == {"time": 3, "lat": 5, "lon": 7}
    assert (head.read(head.variables["mask"]) == np.arange(35).reshape(5, 7)).all() and (head.read(head.variables["n"], 1, 2) == n[1:]).all()
    found = detect(netcdf.open_netcdf(spark, path, ["melt", "n"], slab=40))
    assert found.grid.crs.code == "EPSG:4326" and found.grid.shape == (5, 7) and found.extra == {"time": [0.0, 1.0, 2.0]}
    for r in found.cells.collect():
        want = melt[int(r.time), 4 - r.row, r.col]
        assert r.melt == (None if want == 4 else want) and r.n == n[int(r.time), 4 - r.row, r.col]
    with pytest.raises(GridError):
        netcdf.open_netcdf(spark, path)
    with pytest.raises(ValueError):
        netcdf.open_netcdf(spark, path, ["nope"])
    assert cli.main(["plan", path, "--var", "mask"]) == 0


def test_other_files(tmp_path):
    (tmp_path / "a.nc").write_bytes(b"\x89HDF\r\n\x1a\n")
    with pytest.raises(ValueError):
        netcdf.Header(str(tmp_path / "a.nc"))
