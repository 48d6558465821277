"""Reducing a grid by blocks of 2×2 cells: one shuffle for all variables and methods.

Cells are ``extra dimensions, row, col`` and the variables, nulls for missing data; an absent cell is missing.
The four positions of a block (top left, top right, bottom left, bottom right) become columns, and a method is an
expression over them in that order, so results don't depend on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..grid import Variable

#: What each method is called in metadata, where the name differs.
METADATA_NAMES = {"mean": "average"}


def metadata_name(method: str) -> str:
    return METADATA_NAMES.get(method, method)


def mean(p: list[Column], kind: str) -> Column:
    """The mean of those that aren't null; of whole numbers, rounded half to even."""
    valid = [x.isNotNull().cast("int") for x in p]
    number = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in p]
    value = (((number[0] + number[1]) + number[2]) + number[3]) / F.nullif(((valid[0] + valid[1]) + valid[2]) + valid[3], F.lit(0))
    return value if kind == "f" else F.rint(value)


def mode(p: list[Column]) -> Column:
    """The most frequent of those that aren't null; of several, the first."""
    votes = []
    for x in p:
        same = [F.coalesce((y == x).cast("int"), F.lit(0)) for y in p]
        votes.append(F.when(x.isNull(), -1).otherwise(((same[0] + same[1]) + same[2]) + same[3]))
    most = F.greatest(*votes)
    return F.when(votes[0] == most, p[0]).when(votes[1] == most, p[1]).when(votes[2] == most, p[2]).otherwise(p[3])


def reduced(p: list[Column], method: str, kind: str, spark_type: str, masked_false: bool = True) -> Column:
    """One variable's value from a block's four.

    ``masked_false``: a boolean's False stands for missing data, as it does in a pyramid, so its mode is whether any
    is True; else it has a vote.
    """
    if method == "nearest":
        return p[0]
    if kind == "b":
        number = [x.cast("int") for x in p]
        if method == "mode":
            if masked_false:
                known = [F.coalesce(x, F.lit(False)) for x in p]
                return F.when(F.coalesce(*p).isNotNull(), known[0] | known[1] | known[2] | known[3])
            return mode(p)
        out = {"mean": lambda: mean(number, "i"), "min": lambda: F.least(*number), "max": lambda: F.greatest(*number)}[method]()
        return out.cast("int") == 1
    if method == "mode":
        return mode(p)
    if method == "mean":
        return mean(p, kind).cast(spark_type)
    if method in ("min", "max"):
        return (F.least if method == "min" else F.greatest)(*p)
    raise ValueError(f"unknown method {method!r}")


def halve(cells: DataFrame, variables: Iterable[tuple[Variable, str]], extra: Iterable[str] = (), masked_false: bool = True) -> DataFrame:
    """The cells of the next level. Blocks without a value of any variable are left out."""
    chosen, extra, types = list(variables), list(extra), dict(cells.dtypes)
    at = (F.col("row") % 2) * 2 + F.col("col") % 2
    keys = [F.col(d) for d in extra] + [F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")]
    if all(m == "nearest" for _, m in chosen):  # no block has more than one row that counts: no shuffle
        out = cells.where((F.col("row") % 2 == 0) & (F.col("col") % 2 == 0)).select(*keys, *(v.name for v, _ in chosen))
    else:
        four = cells.groupBy(*keys).agg(*(F.max(F.when(at == k, F.col(v.name))).alias(f"{v.name}__{k}") for v, _ in chosen for k in range(4)))
        out = four.select(*extra, "row", "col", *(reduced([F.col(f"`{v.name}__{k}`") for k in range(4)], m, v.kind, types[v.name], masked_false).alias(v.name) for v, m in chosen))
    return out.where(reduce(or_, (F.col(v.name).isNotNull() for v, _ in chosen)))


def block_centres(centres: np.ndarray, step: float | None = None) -> np.ndarray:
    """The pixel centres of the next level along an axis."""
    from ..grid import grid_step

    if step is None:
        step = grid_step(centres)
    return centres[0] - step / 2 + (2 * np.arange(-(-len(centres) // 2)) + 1) * step
