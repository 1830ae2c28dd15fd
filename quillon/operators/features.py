"""Shape and texture features of series, computed series by series in Arrow batches: no point leaves its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import rounded

FEATURES = {
    "first_third": 6, "second_third": 6, "last_third": 6, "slope": 5, "curvature": 5, "cubic": 5, "skew": 5, "kurtosis": 5,
    "biggest_jump": 6, "jump_rate": 6, "reversal_rate": 6, "lag1": 5,
}


def per_series(series: DataFrame, id_col: str, x_col: str, names: list[str], of: Callable[[np.ndarray], tuple]) -> DataFrame:
    """(id, *names): what ``of`` gives for the values of each series; nulls within a series are NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1)
            values, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            rows = np.array([of(values[a:b]) for a, b in zip(at[:-1], at[1:])], dtype=np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in rows.T]], names=[id_col, *names])

    kind = series.schema[id_col].dataType.simpleString()
    picked = series.where(F.size(x_col) > 0).select(id_col, F.col(x_col).cast("array<double>").alias("x"))
    return picked.mapInArrow(run, f"{id_col} {kind}, " + ", ".join(f"{n} double" for n in names))


def moving_average(series: DataFrame, id_col: str, x_col: str, width: int) -> DataFrame:
    """(id, top, bottom, rough): largest and smallest value of the centred moving average, zeros beyond the edges, and the
    mean distance of the series from it."""

    def of(x: np.ndarray) -> tuple:
        ma = np.convolve(x, np.ones(width))[width // 2 : width // 2 + len(x)] / width
        return ma.max(), ma.min(), np.abs(x - ma).mean()

    names = ["top", "bottom", "rough"]
    return per_series(series, id_col, x_col, names, of).select(id_col, *[rounded(n, 6).alias(n) for n in names])


def _features(x: np.ndarray) -> tuple:
    n = len(x)
    z = (x - x.mean()) / x.std()
    u = 2.0 * np.arange(n) / (n - 1) - 1
    u2 = u * u
    m2, m4 = u2.mean(), (u2 * u2).mean()
    p2, p3 = u2 - m2, u2 * u - m4 / m2 * u
    dz = np.diff(z)
    sign = np.sign(dz)
    a, b = z[:-1] - z[:-1].mean(), z[1:] - z[1:].mean()
    scale = np.sqrt((a @ a) * (b @ b))
    fit = lambda p, lead: lead * (z @ p) / (p @ p) if p @ p > 1e-12 else np.nan
    return (
        z[: n // 3].mean(), z[n // 3 : 2 * n // 3].mean(), z[2 * n // 3 :].mean(), fit(u, 2), fit(p2, 4), fit(p3, 8), (z**3).mean(), (z**4).mean(),
        np.abs(dz).max(), (np.abs(dz) > 1).mean(), (sign[1:] != sign[:-1]).mean(), a @ b / scale if scale > 1e-12 else 0.0,
    )


def series_features(series: DataFrame, id_col: str, x_col: str) -> DataFrame:
    """Twelve features per series: means of thirds, leading least-squares coefficients of degree 1 to 3 on [0, 1],
    population skew and non-excess kurtosis, jumps, direction reversals, lag-1 autocorrelation. Series are z-normed;
    constant series, and those with fewer than four values, are left out."""
    usable = series.where((F.size(x_col) >= 4) & (F.array_max(x_col) > F.array_min(x_col)))
    found = per_series(usable, id_col, x_col, list(FEATURES), _features)
    return found.select(id_col, *[rounded(n, digits).alias(n) for n, digits in FEATURES.items()])
