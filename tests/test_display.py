"""Names, ticks, ranges and colours."""

import datetime as dt
import math

import numpy as np
import pytest

from tessera.functions import display
from tessera.operators import stats


@pytest.mark.parametrize("text,want", [(r"$\Delta$fCO$_2$", "ΔfCO₂"), (r"\mathrm{pCO}_{2}", "pCO₂"), ("m^2", "m²"), (r"\mathbf{\text{a}} \alpha_{10}", "a α₁₀"), (r"\Omega", "Ω"), ("", "v"), ("  a   b ", "a b")])
def test_names(text, want):
    assert display.display_name(text, "v") == want


def test_units():
    assert [display.display_units(u) for u in ("uatm", "m yr-1", "degC", None)] == ["µatm", "m yr⁻¹", "°C", ""]


def test_ticks():
    assert display.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
    assert display.nice_ticks(0, 1) == [0, 0.2, 0.4, 0.6, 0.8, 1.0]
    assert display.nice_ticks(5, 5) == [5]
    for lo, hi in ((-3.7, 12.2), (1e-9, 3e-9), (271.3, 304.8)):
        t = display.nice_ticks(lo, hi)
        assert 4 <= len(t) <= 6 and lo <= t[0] and t[-1] <= hi
    assert display.log_ticks(1, 50) == [1, 2, 5, 10, 20, 50] and display.log_ticks(1, 100) == [1, 10, 100]
    assert display.log_ticks(3, 4) == [3, 4]


def test_values():
    assert display.real(True) is None and display.real(math.nan) is None and display.real(np.float32(2)) == 2.0
    assert display.attr_value([1, 2]) == "1, 2" and display.attr_value(True) == "True" and len(display.attr_value("a" * 3000)) == 2001
    assert display.jsonable({"a": np.array([1, 2]), 3: (np.int8(4),)}) == {"a": [1, 2], "3": [4]}
    assert display.labels(list(range(6000))) is None and display.labels([dt.datetime(2020, 1, 1), 3]) == ["2020-01-01", 3]
    assert display.iso_times([dt.datetime(2020, 1, 1, 6)]) == ["2020-01-01T06:00:00Z"] and display.iso_times([1]) is None
    assert len(display.token("a", "{}")) == 12


def test_colours(caplog):
    assert display.colormap("gray_r")[0] == (255, 255, 255) and len(display.colormap(None)) == 11
    assert display.colormap("nope") == display.colormap("viridis") and "nope" in caplog.text
    assert display.symmetric_colormap("viridis") == "rdbu_r" and display.symmetric_colormap("rdbu") == "rdbu"
    assert display.ramp(10, 1, 100, [(0, 0, 0), (100, 100, 100)], geometric=True) == (50, 50, 50)


def test_statistics(spark):
    df = spark.createDataFrame([(float(v),) for v in (*range(-40, 61), math.nan, math.inf)], "v double")
    want = np.percentile(np.arange(-40, 61), [2, 98])
    assert tuple(stats.limits(df, "v").first()) == tuple(want)
    assert tuple(stats.auto_range(df, "v").first()) == (-want[1], want[1])
    assert stats.auto_range(df, "v", positive=True).first().lo > 0
    assert tuple(stats.extent(df, "v").first()) == (-40.0, 60.0)
    empty = df.where("v = 12345")
    assert tuple(stats.limits(empty, "v").first()) == (0.0, 1.0) and stats.auto_range(empty, "v").first().lo is None
    assert stats.categories(df.where("v between 0 and 50"), "v").count() == 20
    own = lambda **attrs: tuple(stats.with_attrs(spark.createDataFrame([(0.0, 1.0)], "lo double, hi double"), attrs).first())
    assert own(vmin=5, vmax=3) == own(vmin=True) == own(vmax=math.nan) == (0, 1)
    assert own(vmin=2) == (2.0, 3.0) and own(vmax=9) == (0.0, 9.0) and own(vmin=-1, vmax=4) == (-1, 4)


def test_quantiles_of_many_values(spark):
    rng = np.random.default_rng(3)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    for values in (rng.normal(size=5000), np.round(rng.normal(size=5000), 1), np.r_[np.zeros(4000), rng.normal(size=1000) * 1e9], np.full(300, 2.5), 1.0 + np.arange(300) % 3 * 2.0**-52):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = stats.quantiles(df, stats.finite("v"), shares, rows=100, bins=8)
        assert np.allclose(got, np.quantile(values, shares), rtol=1e-12, atol=0)
    assert stats.quantiles(df.where("v > 9"), stats.finite("v"), [0.5]) == [None]
