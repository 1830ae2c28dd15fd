"""Shared views of the tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import arrays as A
from quillon.session import read_table

POOL_SQL = """pool AS (SELECT sample_id, arg_min(series, pair_no) AS x FROM pairs
  WHERE sample_id IS NOT NULL AND len(series) > 0 GROUP BY sample_id)"""
DIGEST_SQL = "list_sum(list_transform({0}, lambda v, i: i * CAST(round(v * 1e6) AS HUGEINT)))::BIGINT"
ORDER_SQL = "list_transform(list_sort(list_transform(range(0, {n}), lambda i: {{'h': md5(sample_id || '|{c}|42|' || i), 'i': i}})), lambda srt: srt.i)"
U_SQL = "((('0x' || substr(md5({0}), 1, 12))::BIGINT + 0.5) / 281474976710656.0::DOUBLE)"
#: Embeddings under a perturbation, as DuckDB expressions of e (list of 64 values).
HALF_SQL = "list_concat(e[33:64], e[1:32])"
SCORES_SQL = "scores AS (SELECT DISTINCT * FROM item_scores WHERE correct IS NOT NULL AND margin::VARCHAR <> 'nan')"


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """One series per sample: that of its first row."""
    return (
        read_table(spark, sf, "pairs")
        .where("sample_id is not null and size(series) > 0")
        .groupBy("sample_id")
        .agg(F.min_by("series", "pair_no").alias("x"))
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def half_swapped(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: every vector with its halves swapped; the ground truth is the vector itself."""
    return vectors(spark, sf).select("id", F.col("id").alias("gt"), A.swap_halves(F.col("vec")).alias("vec"), "label")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Per-item scores without repeated rows, missing outcomes and NaN margins."""
    return read_table(spark, sf, "item_scores").where("correct is not null and not isnan(margin) and margin is not null").distinct()
