"""Perturbations and checks on micro-fixtures: constant, odd, single and empty series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import arrays as A

SERIES = [("a", [3.0, 1.0, 2.0, 5.0, 4.0]), ("b", [7.0] * 6), ("c", [1.5]), ("d", []), ("e", None), ("f", [float(i * i % 37) for i in range(40)])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(SERIES, "id string, x array<double>")


def column(df, expr):
    return {r.id: r.y for r in df.select("id", expr.alias("y")).collect()}


@pytest.mark.parametrize("f", [A.permute, A.permute_first_half, A.permute_within_patches, A.permute_patches])
def test_permutations_keep_values(df, f):
    x = dict(SERIES)
    y = column(df, f(F.col("x"), F.col("id")))
    for k, v in x.items():
        assert (y[k] is None) if v is None else sorted(y[k]) == sorted(v)
    assert y["f"] != x["f"] and y["b"] == x["b"]
    assert y == column(df.repartition(3), f(F.col("x"), F.col("id")))


def test_halves(df):
    y = column(df, A.swap_halves(F.col("x")))
    assert y["a"] == [2.0, 5.0, 4.0, 3.0, 1.0] and y["c"] == [1.5] and y["d"] == []
    tail = column(df, A.permute_first_half(F.col("x"), F.col("id")))
    assert tail["f"][20:] == dict(SERIES)["f"][20:]


def test_patch_blocks_stay_together(df):
    y = column(df, A.permute_patches(F.col("x"), F.col("id"), 16))["f"]
    x = dict(SERIES)["f"]
    blocks = {tuple(x[k : k + 16]) for k in range(0, 40, 16)}
    text = ",".join(map(str, y))
    assert all(",".join(map(str, b)) in text for b in blocks)
    within = column(df, A.permute_within_patches(F.col("x"), F.col("id"), 16))["f"]
    assert all(sorted(within[k : k + 16]) == sorted(x[k : k + 16]) for k in range(0, 40, 16))


def test_znorm(df):
    z = column(df, A.znorm(F.col("x")))
    assert z["b"] == [0.0] * 6 and z["c"] == [0.0] and z["d"] == [] and z["e"] is None
    x = np.array(dict(SERIES)["f"])
    assert np.allclose(z["f"], (x - x.mean()) / x.std())


def test_masks(df):
    y = column(df, A.mask(F.col("x"), F.col("id")))
    assert sum(v == 0 for v in y["a"]) == 1 and y["c"] == [1.5] and y["d"] == []
    filled = column(df, A.mask_with_mean(F.col("x"), F.col("id")))["f"]
    x = dict(SERIES)["f"]
    kept = [v for v, w in zip(x, filled) if v == w]
    assert abs(np.mean(filled) - np.mean(kept)) < 1e-9 and sum(v != w for v, w in zip(x, filled)) <= 8


def test_surrogates(df):
    r = column(df, A.resample(F.col("x"), F.col("id")))
    assert set(r["f"]) <= set(dict(SERIES)["f"]) and len(r["f"]) == 40
    g = column(df, A.gaussian(F.col("x"), F.col("id")))
    assert g["b"] == [7.0] * 6 and len(g["f"]) == 40 and g["e"] is None


def test_resize_and_pad(df):
    y = column(df, A.resize(F.col("x"), 9))
    assert np.allclose(y["a"], np.interp(np.linspace(0, 4, 9), range(5), [3, 1, 2, 5, 4])) and y["c"] == [1.5] * 9 and y["d"] is None
    p = column(df, A.pad(F.col("x"), F.lit(8)))
    assert p["a"] == [3, 1, 2, 5, 4, 0, 0, 0]
    assert column(df, A.serialise(A.znorm(F.col("x"))))["b"] == "0,0,0,0,0,0"
    assert column(df, A.decimate(F.col("x"), 3))["a"] == [3, 2, 4]


def test_normalising_does_not_commute_with_resampling(df):
    before = column(df, A.znorm(A.resample(F.col("x"), F.col("id"))))["f"]
    after = column(df, A.resample(A.znorm(F.col("x")), F.col("id")))["f"]
    assert not np.allclose(before, after)
    commuting = column(df, A.znorm(A.permute(F.col("x"), F.col("id"))))["f"]
    assert np.allclose(commuting, column(df, A.permute(A.znorm(F.col("x")), F.col("id")))["f"])
