"""A small registry of coordinate reference systems: longitude and latitude on three datums, web Mercator, polar and equal-area ones, and UTM."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Crs:
    code: str | None
    wkt: str
    geographic: bool
    proj4: str | None = None


#: Datums by name (ensemble or datum, ellipsoid, its radius and inverse flattening, the geographic code).
DATUMS = {
    "WGS 84": ('ENSEMBLE["World Geodetic System 1984 ensemble",MEMBER["World Geodetic System 1984 (G1762)"],{e},ENSEMBLEACCURACY[2.0]]', "WGS 84", 6378137, 298.257223563, 4326),
    "ETRS89": ('ENSEMBLE["European Terrestrial Reference System 1989 ensemble",MEMBER["European Terrestrial Reference Frame 1989"],{e},ENSEMBLEACCURACY[0.1]]', "GRS 1980", 6378137, 298.257222101, 4258),
    "NAD83": ('DATUM["North American Datum 1983",{e}]', "GRS 1980", 6378137, 298.257222101, 4269),
}
#: Projected systems by code: name, datum, method, its parameters in the method's order, axes, proj4.
PROJECTED = {
    3857: ("WGS 84 / Pseudo-Mercator", "WGS 84", "Popular Visualisation Pseudo Mercator", (0, 0, 0, 0), ("east", "north"), "+proj=merc +a=6378137 +b=6378137 +units=m +no_defs"),
    3031: ("WGS 84 / Antarctic Polar Stereographic", "WGS 84", "Polar Stereographic (variant B)", (-71, 0, 0, 0), ("north", "north"), "+proj=stere +lat_0=-90 +lat_ts=-71 +lon_0=0 +datum=WGS84 +units=m +no_defs"),
    3413: ("WGS 84 / NSIDC Sea Ice Polar Stereographic North", "WGS 84", "Polar Stereographic (variant B)", (70, -45, 0, 0), ("south", "south"), "+proj=stere +lat_0=90 +lat_ts=70 +lon_0=-45 +datum=WGS84 +units=m +no_defs"),
    3995: ("WGS 84 / Arctic Polar Stereographic", "WGS 84", "Polar Stereographic (variant B)", (71, 0, 0, 0), ("south", "south"), "+proj=stere +lat_0=90 +lat_ts=71 +lon_0=0 +datum=WGS84 +units=m +no_defs"),
    32661: ("WGS 84 / UPS North (N,E)", "WGS 84", "Polar Stereographic (variant A)", (90, 0, 0.994, 2000000, 2000000), ("south", "south"), "+proj=stere +lat_0=90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84 +units=m +no_defs"),
    32761: ("WGS 84 / UPS South (N,E)", "WGS 84", "Polar Stereographic (variant A)", (-90, 0, 0.994, 2000000, 2000000), ("north", "north"), "+proj=stere +lat_0=-90 +lon_0=0 +k=0.994 +x_0=2000000 +y_0=2000000 +datum=WGS84 +units=m +no_defs"),
    6931: ("WGS 84 / NSIDC EASE-Grid 2.0 North", "WGS 84", "Lambert Azimuthal Equal Area", (90, 0, 0, 0), ("south", "south"), "+proj=laea +lat_0=90 +lon_0=0 +datum=WGS84 +units=m +no_defs"),
    6932: ("WGS 84 / NSIDC EASE-Grid 2.0 South", "WGS 84", "Lambert Azimuthal Equal Area", (-90, 0, 0, 0), ("north", "north"), "+proj=laea +lat_0=-90 +lon_0=0 +datum=WGS84 +units=m +no_defs"),
    6933: ("WGS 84 / NSIDC EASE-Grid 2.0 Global", "WGS 84", "Lambert Cylindrical Equal Area", (30, 0, 0, 0), ("east", "north"), "+proj=cea +lat_ts=30 +lon_0=0 +datum=WGS84 +units=m +no_defs"),
    3035: ("ETRS89-extended / LAEA Europe", "ETRS89", "Lambert Azimuthal Equal Area", (52, 10, 4321000, 3210000), ("east", "north"), "+proj=laea +lat_0=52 +lon_0=10 +x_0=4321000 +y_0=3210000 +ellps=GRS80 +units=m +no_defs"),
    3034: ("ETRS89-extended / LCC Europe", "ETRS89", "Lambert Conic Conformal (2SP)", (52, 10, 35, 65, 4000000, 2800000), ("east", "north"), "+proj=lcc +lat_0=52 +lon_0=10 +lat_1=35 +lat_2=65 +x_0=4000000 +y_0=2800000 +ellps=GRS80 +units=m +no_defs"),
    5070: ("NAD83 / Conus Albers", "NAD83", "Albers Equal Area", (23, -96, 29.5, 45.5, 0, 0), ("east", "north"), "+proj=aea +lat_0=23 +lon_0=-96 +lat_1=29.5 +lat_2=45.5 +datum=NAD83 +units=m +no_defs"),
    3338: ("NAD83 / Alaska Albers", "NAD83", "Albers Equal Area", (50, -154, 55, 65, 0, 0), ("east", "north"), "+proj=aea +lat_0=50 +lon_0=-154 +lat_1=55 +lat_2=65 +datum=NAD83 +units=m +no_defs"),
}
_ORIGIN, _SHIFT = (("Latitude of natural origin", "deg"), ("Longitude of natural origin", "deg")), (("False easting", "m"), ("False northing", "m"))
_FALSE = (("Latitude of false origin", "deg"), ("Longitude of false origin", "deg"), ("Latitude of 1st standard parallel", "deg"), ("Latitude of 2nd standard parallel", "deg"), ("Easting at false origin", "m"), ("Northing at false origin", "m"))
_SCALE = ("Scale factor at natural origin", "1")
#: The parameters of each method, with their units.
METHODS = {
    "Popular Visualisation Pseudo Mercator": (*_ORIGIN, *_SHIFT), "Lambert Azimuthal Equal Area": (*_ORIGIN, *_SHIFT), "Transverse Mercator": (*_ORIGIN, _SCALE, *_SHIFT), "Polar Stereographic (variant A)": (*_ORIGIN, _SCALE, *_SHIFT),
    "Polar Stereographic (variant B)": (("Latitude of standard parallel", "deg"), ("Longitude of origin", "deg"), *_SHIFT), "Lambert Cylindrical Equal Area": (("Latitude of 1st standard parallel", "deg"), ("Longitude of natural origin", "deg"), *_SHIFT),
    "Lambert Conic Conformal (2SP)": _FALSE, "Albers Equal Area": (*_FALSE[:4], *_FALSE[4:]),
}
UNITS = {"deg": 'ANGLEUNIT["degree",0.0174532925199433]', "m": 'LENGTHUNIT["metre",1]', "1": 'SCALEUNIT["unity",1]'}


def _datum(name: str) -> str:
    frame, ellipsoid, radius, flattening, _ = DATUMS[name]
    return f'{frame.format(e=f'ELLIPSOID["{ellipsoid}",{radius},{flattening},{UNITS["m"]}]')},PRIMEM["Greenwich",0,{UNITS["deg"]}]'


def _utm(code: int) -> tuple | None:
    """The description of a UTM zone by its code's family: WGS 84 north and south, ETRS89, NAD83."""
    for first, last, datum, south in ((32601, 32660, "WGS 84", False), (32701, 32760, "WGS 84", True), (25828, 25838, "ETRS89", False), (26901, 26923, "NAD83", False)):
        if first <= code <= last:
            zone = code % 100
            proj4 = {"WGS 84": "+datum=WGS84", "ETRS89": "+ellps=GRS80", "NAD83": "+datum=NAD83"}[datum]
            return (f"{datum} / UTM zone {zone}{'S' if south else 'N'}", datum, "Transverse Mercator", (0, 6 * zone - 183, 0.9996, 500000, 10000000 if south else 0), ("east", "north"), f"+proj=utm +zone={zone}{' +south' if south else ''} {proj4} +units=m +no_defs")
    return None


def from_epsg(code: int) -> Crs:
    """The CRS of a code that the registry can describe."""
    for name, (*_, own) in DATUMS.items():
        if code == own:
            axes = ",".join(f'AXIS["geodetic {a}",{d},ORDER[{k}],{UNITS["deg"]}]' for k, (a, d) in enumerate((("latitude (Lat)", "north"), ("longitude (Lon)", "east")), 1))
            return Crs(f"EPSG:{code}", f'GEOGCRS["{name}",{_datum(name)},CS[ellipsoidal,2],{axes},ID["EPSG",{code}]]', True, {"WGS 84": "+proj=longlat +datum=WGS84 +no_defs", "ETRS89": "+proj=longlat +ellps=GRS80 +no_defs", "NAD83": "+proj=longlat +datum=NAD83 +no_defs"}[name])
    if (found := PROJECTED.get(code) or _utm(code)) is None:
        raise ValueError(f"EPSG:{code} isn't in the registry; give its WKT")
    name, datum, method, values, ways, proj4 = found
    given = ",".join(f'PARAMETER["{n}",{v:.10g},{UNITS[u]}]' for (n, u), v in zip(METHODS[method], values, strict=True))
    axes = ",".join(f'AXIS["{a}",{d},ORDER[{k}]]' for k, (a, d) in enumerate(zip(("easting (E)", "northing (N)"), ways, strict=True), 1))
    wkt = f'PROJCRS["{name}",BASEGEOGCRS["{datum}",{_datum(datum)},ID["EPSG",{DATUMS[datum][4]}]],CONVERSION["{name}",METHOD["{method}"],{given}],CS[Cartesian,2],{axes},{UNITS["m"]},ID["EPSG",{code}]]'
    return Crs(f"EPSG:{code}", wkt, False, proj4)


def parse(value: Any) -> Crs:
    """A CRS from a code (``EPSG:n`` or a number), WKT or another ``Crs``."""
    if isinstance(value, Crs):
        return value
    if isinstance(value, int):
        return from_epsg(value)
    text = str(value).strip()
    if m := re.fullmatch(r"(?i)epsg:(\d+)", text):
        return from_epsg(int(m[1]))
    if re.match(r"(GEOG|GEOD|PROJ|BOUND|COMPOUND)(CRS|CS)\[", text):
        code = re.search(r'ID\["EPSG",(\d+)\]\]$|AUTHORITY\["EPSG","(\d+)"\]\]$', text)
        return Crs(f"EPSG:{code[1] or code[2]}" if code else None, text, text.startswith("GEO"))
    raise ValueError(f"not a CRS: {value!r}")


def from_mapping(attrs: Mapping[str, Any]) -> Crs | None:
    """The CRS that a CF grid mapping's attributes describe, as far as they hold WKT, a code or plain longitude and latitude."""
    for key in ("crs_wkt", "spatial_ref", "epsg_code", "spatial_epsg"):
        if attrs.get(key):
            value = attrs[key]
            return parse(int(value) if str(value).isdigit() else value)
    if attrs.get("grid_mapping_name") == "latitude_longitude":
        return from_epsg(4326)
    if attrs.get("grid_mapping_name") == "polar_stereographic":
        wanted = float(attrs.get("standard_parallel", 0)), float(attrs.get("straight_vertical_longitude_from_pole", 0))
        return {(-71.0, 0.0): from_epsg(3031), (70.0, -45.0): from_epsg(3413), (71.0, 0.0): from_epsg(3995)}.get(wanted)
    return None
