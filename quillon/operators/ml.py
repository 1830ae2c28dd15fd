"""Classifiers over series features, and batched encoders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.sampling import hash_ranks
from quillon.session import stage


def _stages(label: str, columns: list[str], penalty: float) -> list:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler

    return [
        StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=columns, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True),
        LogisticRegression(featuresCol="x", labelCol="y", regParam=penalty, maxIter=15),
    ]


def cross_validate(features: DataFrame, label: str, columns: list[str], key: str, folds: int = 5, c: float = 1.0) -> DataFrame:
    """(key, label, prediction, fold): out-of-fold predictions of a standardised logistic regression; folds are dealt per
    label by hash order. Every fold is fitted on all rows of the others."""
    from pyspark.ml import Pipeline

    data = hash_ranks(features.na.fill(0.0, columns), [label], key, None).withColumn("fold", F.col("nth") % folds)
    data = stage(data, "folds")
    stages = _stages(label, columns, 1.0 / (c * max(1, data.count())))
    out = None
    for k in range(folds):
        model = Pipeline(stages=stages).fit(data.where(F.col("fold") != k))
        part = model.transform(data.where(F.col("fold") == k)).select(key, label, (F.col("prediction") == F.col("y")).alias("right"), "fold")
        out = part if out is None else out.unionByName(part)
    return out


def fit(rows: DataFrame, columns: list[str], label: str = "label", c: float = 1.0):
    """The standardised logistic regression fitted on all rows."""
    from pyspark.ml import Pipeline

    rows = stage(rows, "fit-rows")
    return Pipeline(stages=_stages(label, columns, 1.0 / (c * max(1, rows.count())))).fit(rows)


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def encode_series(series: DataFrame, width: int = 8, seed: int = 7, budget: int = 16384) -> DataFrame:
    """(id, vec): random projections of the normalised series of ``series(id, x)``, in batches of equal length with at
    most ``budget`` values. A stand-in for a model; any ``ndarray -> ndarray`` encoder fits the same place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, xs = batch.column(0), batch.column(1)
            values, offsets = xs.values.to_numpy(zero_copy_only=False), xs.offsets.to_numpy()
            lengths = np.diff(offsets)
            for length in np.unique(lengths[lengths > 0]):
                rows = np.flatnonzero(lengths == length)
                projection = np.random.default_rng(seed + int(length)).normal(size=(int(length), width))
                step = max(1, min(64, budget // int(length)))
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    block = values[offsets[part][:, None] + np.arange(length)]
                    block = block - block.mean(axis=1, keepdims=True)
                    v = (block @ projection).ravel()
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, width, dtype=np.int32)), pa.array(v))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(part)), lists], names=["id", "vec"])

    return series.select("id", "x").mapInArrow(run, "id string, vec array<double>")
