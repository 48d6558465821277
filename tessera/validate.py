"""Checks of a stored pyramid. What is wrong is reported, not raised; only a missing store raises."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metadata import CONVENTIONS
from .plans.levels import Plan
from .store import Files, Pyramid, open_pyramid

KEYS = ("zarr_conventions", "multiscales", "spatial", "proj", "structure")


def close(a: Any, b: Any) -> bool:
    """Equal within 1e-9 of the size, or 1e-12."""
    return len(a) == len(b) and all(abs(x - y) <= max(1e-9 * max(abs(x), abs(y)), 1e-12) for x, y in zip(a, b, strict=True))


def is_valid(report: dict[str, list[str]]) -> bool:
    return not any(report.values())


def _safely(report: dict[str, list[str]], key: str, check, *args) -> None:
    """A check whose own error, at content of no known form, is one more message."""
    try:
        check(*args)
    except Exception as e:
        report[key].append(f"content of an unknown form: {type(e).__name__}: {e}")


def validate(spark: SparkSession, path: str, group: str | None = None, plan: Plan | None = None, cells: bool = False) -> dict[str, list[str]]:
    """Messages by check. ``plan`` compares the store with what it should be; ``cells`` reads all levels for missing blocks."""
    report: dict[str, list[str]] = {k: [] for k in KEYS}
    p = open_pyramid(spark, path, group)
    attrs = p.doc.get("attrs") if isinstance(p.doc, dict) else None
    attrs = attrs if isinstance(attrs, dict) else {}
    declared = attrs.get("zarr_conventions")
    ids = {c.get("uuid") for c in declared if isinstance(c, dict)} if isinstance(declared, list) else set()
    report["zarr_conventions"] += [f"the convention {k!r} isn't declared" for k, c in CONVENTIONS.items() if c["uuid"] not in ids]
    layout = attrs["multiscales"].get("layout") if isinstance(attrs.get("multiscales"), dict) else None
    if not isinstance(layout, list) or not layout:
        report["multiscales"].append("there is no layout")
        layout = []
    if not attrs.get("spatial:dimensions"):
        report["spatial"].append("spatial:dimensions is missing")
    if not any(str(k).startswith("proj:") for k in attrs):
        report["proj"].append("no projection is declared")
    seen: list[str] = []
    for x in layout:
        if not isinstance(x, dict):
            report["multiscales"].append(f"an entry of the layout isn't a mapping: {x!r}")
            continue
        asset = str(x.get("asset"))
        if (origin := x.get("derived_from")) is not None:
            if str(origin) not in seen:
                report["multiscales"].append(f"{asset} is derived from {origin!r}, which isn't an earlier asset")
            if "transform" not in x:
                report["multiscales"].append(f"{asset} is derived and has no transform")
        seen.append(asset)
    _safely(report, "structure", check_levels, p, seen, attrs, report)
    if plan is not None:
        _safely(report, "structure", check_plan, p, plan, report)
    if cells and not report["structure"]:
        _safely(report, "structure", check_cells, p, report)
    return report


def check_levels(p: Pyramid, assets: list[str], attrs: dict[str, Any], report: dict[str, list[str]]) -> None:
    there, sets = set(Files(p.spark).names(p.path)), {}
    extents = []
    for asset in assets:
        own = (p.doc.get("levels") or {}).get(asset)
        if own is None or f"level={asset}" not in there:
            report["structure"].append(f"level {asset} doesn't exist")
            continue
        has = own.get("attrs") or {}
        for key in ("spatial:transform", "spatial:shape"):
            if key not in has:
                report["spatial"].append(f"level {asset} lacks {key}")
        if not any(k.startswith("proj:") for k in (*has, *attrs)):
            report["proj"].append(f"level {asset} has no projection")
        try:
            cells = p.level(int(asset))
            sets[asset] = set(cells.columns) - {"row", "col", *p.doc["grid"]["extra"]}
            extents.append(cells.agg(F.max("row").alias("r"), F.max("col").alias("c")).select(F.lit(asset).alias("asset"), "r", "c"))
        except Exception as e:  # whatever the store holds, a report comes back
            report["structure"].append(f"level {asset} can't be read: {type(e).__name__}")
            continue
        for n, lay in own.get("layouts", {}).items():
            if list(lay["shape"][-2:]) != list(has.get("spatial:shape", [])):
                report["spatial"].append(f"the shape of {n} at level {asset} isn't spatial:shape")
    if len({frozenset(s) for s in sets.values()}) > 1:
        report["structure"].append(f"levels have different variables: { {k: sorted(v) for k, v in sets.items()} }")
    for r in [r for e in extents for r in e.collect()]:
        shape = p.doc["levels"][r.asset]["attrs"].get("spatial:shape", [0, 0])
        if r.r is not None and (r.r >= shape[0] or r.c >= shape[1]):
            report["spatial"].append(f"level {r.asset} has cells outside its shape")


def missing_blocks(fine: DataFrame, coarse: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``extra…, row, col`` of the blocks that a level should have for the cells of the one before it, and lacks."""
    keys = [*(extra or []), "row", "col"]
    whole = fine.select(*(extra or []), *(F.floor(F.col(c) / 2).cast("int").alias(c) for c in ("row", "col"))).distinct()
    return whole.join(coarse.select(*keys), keys, "left_anti")


def check_cells(p: Pyramid, report: dict[str, list[str]]) -> None:
    """Whether every level has a block for all cells of the one before it."""
    names = [v["name"] for v in p.doc["variables"]]
    real = [f"`{n}` is not null" for n in names]
    for k in range(1, p.n_levels):
        lacking = missing_blocks(p.level(k - 1).where(" or ".join(real)), p.level(k), list(p.doc["grid"]["extra"])).count()
        if lacking:
            report["structure"].append(f"level {k} lacks {lacking} blocks")


def check_plan(p: Pyramid, plan: Plan, report: dict[str, list[str]]) -> None:
    if len(plan.levels) != p.n_levels:
        report["structure"].append(f"{p.n_levels} levels, {len(plan.levels)} are planned")
    for v in plan.levels:
        own = p.doc["levels"].get(str(v.index))
        if own is None:
            continue
        if list(own["attrs"].get("spatial:shape", [])) != list(v.shape):
            report["structure"].append(f"level {v.index}: the shape isn't the plan's")
        if not close(own["attrs"].get("spatial:transform", []), v.transform):
            report["structure"].append(f"level {v.index}: the transform isn't the plan's")
        if set(own["layouts"]) != set(v.layouts):
            report["structure"].append(f"level {v.index}: the variables aren't the plan's")
        for n in set(own["layouts"]) & set(v.layouts):
            want = v.layouts[n]
            if tuple(own["layouts"][n]["chunks"]) != want.chunks or (tuple(own["layouts"][n]["shards"] or ()) or None) != want.shards:
                report["structure"].append(f"level {v.index}: the chunks of {n} aren't the plan's")


def to_df(spark: SparkSession, report: dict[str, list[str]]) -> DataFrame:
    return spark.createDataFrame([(k, m) for k, ms in report.items() for m in ms], "check string, message string")
