"""Reading a pyramid by place: points, windows and dense views."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cell_at(transform: tuple[float, ...], x: float, y: float) -> tuple[int, int]:
    """Row and column of the pixel that holds a point."""
    a, _, c, _, e, f = transform
    return math.floor((f - y) / abs(e)), math.floor((x - c) / a)


def point(cells: DataFrame, transform: tuple[float, ...], x: float, y: float) -> DataFrame:
    """The cells at a point: none where there is no data. The filters reach the scan."""
    row, col = cell_at(transform, x, y)
    return cells.where((F.col("row") == row) & (F.col("col") == col))


def sample(levels: Iterable[tuple[DataFrame, tuple[float, ...], tuple[int, int]]], x: float, y: float) -> DataFrame | None:
    """The cells at a point of the finest level whose extent holds it; ``levels`` come finest first."""
    for cells, transform, (ny, nx) in levels:
        row, col = cell_at(transform, x, y)
        if 0 <= row < ny and 0 <= col < nx:
            return point(cells, transform, x, y)
    return None


def window(cells: DataFrame, transform: tuple[float, ...], shape: tuple[int, int], bbox: tuple[float, float, float, float]) -> DataFrame:
    """The cells whose pixels meet a box (west, south, east, north)."""
    a, _, c, _, e, f = transform
    west, south, east, north = bbox
    top, bottom = max(0, math.floor((f - north) / abs(e))), min(shape[0], math.ceil((f - south) / abs(e))) - 1
    left, right = max(0, math.floor((west - c) / a)), min(shape[1], math.ceil((east - c) / a)) - 1
    return cells.where(F.col("row").between(top, bottom) & F.col("col").between(left, right))


def dense(cells: DataFrame, shape: tuple[int, int], extra: Mapping[str, list] | None = None) -> DataFrame:
    """Every cell of the grid, with nulls where there is none; for results that must have no holes.

    The axes are made by ``explode``, row by row: the grid is as large as asked for and no larger.
    """
    axes = cells.sparkSession.range(shape[0]).select(F.col("id").cast("int").alias("row"))
    for d, values in (extra or {}).items():
        axes = axes.withColumn(d, F.explode(F.array(*map(F.lit, values))))
    axes = axes.withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(shape[1] - 1))))
    return axes.join(cells, [*(extra or {}), "row", "col"], "left")


def frame(cells: DataFrame, indices: Mapping[str, object]) -> DataFrame:
    """The slice at one value of each extra dimension."""
    for d, v in indices.items():
        cells = cells.where(F.col(d) == v)
    return cells


def strided(cells: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column, for a quick look; the limit is the feature."""
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0))


def frame_values(levels: Iterable[tuple[DataFrame, tuple[int, int]]], indices: Mapping[str, object], most: int = 200_000) -> DataFrame:
    """The cells of one slice at the finest level of those given (finest first), every n-th row and column so that ``most`` are left at most.

    The limit is the feature: a quick look at a frame's values.
    """
    cells, (ny, nx) = next(iter(levels))
    step = 1
    while math.ceil(ny / step) * math.ceil(nx / step) > most:
        step += 1
    return strided(frame(cells, indices), step)
