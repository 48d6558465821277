"""What is shown of values, as column expressions: the counterparts of ``display`` for whole tables."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import display


def iso_label(time: Column) -> Column:
    """A timestamp without a time of day that is midnight."""
    return F.regexp_replace(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), "T00:00:00$", "")


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def palette(code: Column) -> Column:
    """The colour of a category's number, over and over."""
    return F.element_at(F.array(*map(F.lit, display.PALETTE)), (F.pmod(code, F.lit(len(display.PALETTE))) + 1).cast("int"))


def significant(value: Column, digits: int = 10) -> Column:
    return F.format_string(f"%.{digits - 1}e", value.cast("double")).cast("double")


def ramp(value: Column, low: float, high: float, stops: list[tuple[int, int, int]], geometric: bool = False) -> Column:
    """Red, green and blue at a value as an array: linear between evenly or, if geometric, evenly log-spaced stops."""
    value = value.cast("double")
    if geometric:
        value, low, high = F.log(F.greatest(value, F.lit(1e-300))), math.log(low), math.log(high)
    place = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low))) * (len(stops) - 1)
    k = F.least(F.floor(place).cast("int"), F.lit(len(stops) - 2))
    table = F.array(*(F.array(*map(F.lit, s)) for s in stops))
    return F.zip_with(F.element_at(table, k + 1), F.element_at(table, k + 2), lambda a, b: F.rint(a + (b - a) * (place - k)).cast("int"))
