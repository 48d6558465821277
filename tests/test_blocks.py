"""Block reducers against a plain loop."""

import math
from collections import Counter

import numpy as np
import pytest

from tessera.grid import Variable
from tessera.operators.blocks import block_centres, halve, metadata_name


def variable(dtype, fill):
    return Variable("v", dtype, ("y", "x"), (1, 1), np.dtype(dtype).kind in "iub", fill, False)


def plain(a, method, fill):
    """One value for each block: missing values don't count; None if none is left."""
    missing = (lambda v: math.isnan(v)) if a.dtype.kind == "f" else (lambda v: v == fill)
    out = {}
    for i in range(0, a.shape[0], 2):
        for j in range(0, a.shape[1], 2):
            four = [a[r, c] for r in (i, i + 1) for c in (j, j + 1) if r < a.shape[0] and c < a.shape[1]]
            real = [v for v in four if not missing(v)]
            if method == "nearest":
                value = None if missing(a[i, j]) else a[i, j]
            elif not real:
                value = None
            elif method == "mode":
                n = Counter(real)
                value = next(v for v in real if n[v] == max(n.values()))
            elif method == "mean":
                value = np.mean(np.array(real, np.float64))
                value = np.rint(value) if a.dtype.kind != "f" else value
            else:
                value = (min if method == "min" else max)(real)
            if value is not None:
                out[i // 2, j // 2] = float(value)
    return out


def cells(spark, a, fill):
    kind = {"f": "float" if a.dtype.itemsize == 4 else "double", "b": "boolean"}.get(a.dtype.kind, "long")
    missing = np.isnan(a) if a.dtype.kind == "f" else a == fill if fill is not None else np.zeros(a.shape, bool)
    rows = [(int(r), int(c), None if missing[r, c] else a[r, c].item()) for r, c in np.ndindex(*a.shape)]
    return spark.createDataFrame(rows, f"row int, col int, v {kind}")


@pytest.mark.parametrize("shape", [(7, 5), (8, 6), (1, 1), (1, 9), (3, 1)])
@pytest.mark.parametrize("dtype", ["float32", "float64", "int16"])
def test_methods_match_a_plain_loop(spark, shape, dtype):
    rng = np.random.default_rng(sum(shape))
    a = rng.normal(size=shape).astype(dtype) if dtype[0] == "f" else rng.integers(-2, 4, shape).astype(dtype)
    if dtype[0] == "f":
        a[rng.random(shape) < 0.3] = np.nan
    fill = math.nan if dtype[0] == "f" else -1
    source = cells(spark, a, fill)
    for method in ("mean", "min", "max", "nearest", "mode"):
        got = {(r.row, r.col): float(r.v) for r in halve(source, [(variable(dtype, fill), method)]).collect()}
        want = plain(a, method, fill)
        assert got.keys() == want.keys(), method
        assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want), method


@pytest.mark.parametrize("four,want", [([[1, 2], [2, 1]], 1), ([[3, 1], [2, 2]], 2), ([[5, 6], [7, 8]], 5), ([[-1, 2], [3, -1]], 2)])
def test_ties_of_the_mode_go_to_the_first(spark, four, want):
    got = halve(cells(spark, np.array(four, np.int16), -1), [(variable("int16", -1), "mode")]).collect()
    assert [r.v for r in got] == [want]


@pytest.mark.parametrize("four,want", [([[1, 2], [2, 2]], 2), ([[1, 2], [1, 2]], 2), ([[0, 1], [1, 0]], 0), ([[1, 1], [1, 1]], 1)])
def test_means_of_whole_numbers_round_half_to_even(spark, four, want):
    got = halve(cells(spark, np.array(four, np.int32), -9), [(variable("int32", -9), "mean")]).collect()
    assert [r.v for r in got] == [want]


def test_booleans(spark):
    a = np.array([[True, False], [False, False]])
    v = variable("bool", False)
    source = cells(spark, a, None)
    assert halve(source, [(v, "mode")]).first().v is True
    assert halve(source, [(v, "mode")], masked_false=False).first().v is False
    assert halve(source, [(v, "mean")]).first().v is False
    assert halve(source, [(v, "max")]).first().v is True


def test_slices_stay_apart_and_one_shuffle_is_enough(spark):
    rows = [(t, r, c, float(100 * t + r + c)) for t in range(3) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(rows, "time int, row int, col int, v double")
    out = halve(df, [(variable("float64", math.nan), "mean")], ["time"])
    assert out.count() == 12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        halve(cells(spark, np.ones((2, 2), np.float32), None), [(variable("float32", math.nan), "median")])


def test_names_and_centres():
    assert metadata_name("mean") == "average" and metadata_name("mode") == "mode"
    assert block_centres(np.arange(5.0)).tolist() == [0.5, 2.5, 4.5]
    assert block_centres(np.array([7.0]), 2.0).tolist() == [8.0]
