"""Bit rounding: floats keep some bits of their mantissa, rounded to nearest, half to even."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA = {"float32": (np.uint32, 23), "float64": (np.uint64, 52)}


def bitround(values: np.ndarray, bits: int) -> np.ndarray:
    """Values that aren't finite stay as they are."""
    kind, mantissa = MANTISSA[values.dtype.name]
    drop = mantissa - bits
    if drop <= 0:
        return values
    raw = values.view(kind)
    half, one = kind((1 << (drop - 1)) - 1), kind(1)
    rounded = (raw + half + ((raw >> kind(drop)) & one)) & ~kind((1 << drop) - 1)
    return np.where(np.isfinite(values), rounded, raw).astype(kind).view(values.dtype)


def rounded(column: str, dtype: str, bits: int) -> Column:
    """The rounded column as an Arrow-batched expression; nulls stay null."""

    @F.pandas_udf("float" if dtype == "float32" else "double")
    def run(s: pd.Series) -> pd.Series:
        kept = s.to_numpy(np.dtype(dtype), na_value=np.nan)
        return pd.Series(bitround(np.ascontiguousarray(kept), bits)).where(s.notna().to_numpy(), None)

    return run(F.col(column)).alias(column)


def quantize(cells: DataFrame, keepbits: Mapping[str, int], dtypes: Mapping[str, str]) -> DataFrame:
    if not keepbits:
        return cells
    return cells.select(*(rounded(c, dtypes[c], keepbits[c]) if c in keepbits else F.col(c) for c in cells.columns))
