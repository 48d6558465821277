"""Statistics for display: percentile limits, categories, extents and automatic ranges."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns, display

log = logging.getLogger("tessera")


def finite(column: str) -> Column:
    """The value where it is a finite number."""
    c = F.col(column).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _ranked(values: DataFrame, rank: int, low: float, high: float, rows: int, bins: int) -> float:
    """The value (column ``v``) of a rank, by counting in bins and looking closer at the one that holds it.

    A pass gives ``bins`` rows at most; a bin of equal values, or of ``rows`` values at most, ends the search.
    """
    while low < high:
        place = F.least(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(bins - 1))
        inside = values.where(F.col("v").between(low, high))
        counts = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        for r in counts:
            if rank < r.n:
                break
            rank -= r.n
        if r.n <= rows and r.lo < r.hi:
            share = rank / (r.n - 1)
            return inside.where(F.col("v").between(r.lo, r.hi)).agg(F.percentile("v", F.lit(share))).first()[0]
        if (r.lo, r.hi) == (low, high):  # numbers too close to tell apart by bins
            ordered = inside.groupBy("v").count().orderBy("v").toLocalIterator()
            for r in ordered:
                if rank < r["count"]:
                    return r.v
                rank -= r["count"]
        low, high = r.lo, r.hi
    return low


def quantiles(cells: DataFrame, value: Column, shares: list[float], rows: int = 1_000_000, bins: int = 4096) -> list[float | None]:
    """Exact quantiles, linear between ranks; nulls without data.

    Up to ``rows`` values are one aggregate; more are counted in bins first, so that no task holds them all.
    """
    values = cells.select(value.alias("v")).where(F.col("v").isNotNull())
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if n <= rows:
        return list(values.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0] or [None] * len(shares))
    found: dict[int, float] = {}
    out = []
    for share in shares:
        at = (n - 1) * share
        for rank in {int(at), min(n - 1, int(at) + 1)}:
            if rank not in found:
                found[rank] = _ranked(values, rank, low, high, rows, bins)
        first, second = found[int(at)], found[min(n - 1, int(at) + 1)]
        out.append(first if first == second else (int(at) + 1 - at) * first + (at - int(at)) * second)
    return out


def _one_row(cells: DataFrame, found: list[float | None]) -> DataFrame:
    return cells.sparkSession.createDataFrame([tuple(found)], "lo double, hi double")


def limits(cells: DataFrame, column: str) -> DataFrame:
    """``lo, hi``: the 2nd and the 98th percentile, interpolated; 0 and 1 without data."""
    found = _one_row(cells, quantiles(cells, finite(column), [0.02, 0.98]))
    return found.select(F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))


def extent(cells: DataFrame, column: str) -> DataFrame:
    """``lo, hi``: smallest and largest; a constant is widened by 1."""
    found = cells.agg(F.min(finite(column)).alias("lo"), F.max(finite(column)).alias("hi"))
    return found.select("lo", F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("lo") + 1).alias("hi"))


def auto_range(cells: DataFrame, column: str, positive: bool = False) -> DataFrame:
    """``lo, hi``: the percentiles, made symmetric if they are on both sides of 0 and the nearer is half as far at least; nulls without data."""
    v = finite(column)
    if positive:
        v = F.when(v > 0, v)
    found = _one_row(cells, quantiles(cells, v, [0.02, 0.98]))
    near, far = F.least(F.abs("lo"), F.abs("hi")), F.greatest(F.abs("lo"), F.abs("hi"))
    both = (F.col("lo") < 0) & (F.col("hi") > 0) & (near / far >= 0.5)
    return found.select(
        F.when(both, -far).otherwise(F.col("lo")).alias("lo"),
        F.when(both, far).when(F.col("hi") <= F.col("lo"), F.col("lo") + 1).otherwise(F.col("hi")).alias("hi"),
    )


def categories(cells: DataFrame, column: str, most: int = display.MAX_CATEGORIES) -> DataFrame:
    """``code, value, color``: the smallest distinct values, ``most`` of them, with a colour each."""
    found = cells.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().orderBy("value").limit(most)
    one = found.agg(F.sort_array(F.collect_list("value")).alias("v")).select(F.posexplode("v").alias("code", "value"))
    return one.select("code", "value", columns.palette(F.col("code")).alias("color"))


def with_attrs(found: DataFrame, attrs: Mapping[str, Any]) -> DataFrame:
    """``lo, hi`` of ``found``, each overridden by the variable's own ``vmin`` or ``vmax``.

    Both are ignored, with a warning, where they leave no range between them; a range that is empty in the end is 1 wide.
    """
    asked = [display.real(attrs.get(k)) for k in ("vmin", "vmax")]
    if None not in asked and asked[1] <= asked[0]:
        log.warning("vmin and vmax %s leave no range and are ignored", asked)
        asked = [None, None]
    lo, hi = (F.coalesce(F.lit(x).cast("double"), F.col(c).cast("double")) for x, c in zip(asked, ("lo", "hi"), strict=True))
    return found.select(lo.alias("lo"), F.when(hi > lo, hi).otherwise(lo + 1).alias("hi"))
