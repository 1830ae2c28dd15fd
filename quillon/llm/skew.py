"""Joins whose left side has hot keys: a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stage


def hot_keys(counted: DataFrame, key: str, least: int = 1000, share: float = 1e-4) -> DataFrame:
    """(key): those of ``counted(key, n)`` that hold at least ``least`` rows and the given share of all rows.

    There are at most 1/share of them, so the list can be broadcast whatever the size of the table."""
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))  # one row
    hot = counted.crossJoin(F.broadcast(total)).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))
    return stage(hot.select(key), "hot-keys")


def attach(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """``rows`` joined with ``side``, which has one row per key: rows of the ``hot`` keys meet their few side rows through
    a broadcast and stay where they are, all others through a shuffle; rows with a null key are not moved at all."""
    marked = rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    few = F.broadcast(side.join(F.broadcast(hot), key, "left_semi"))
    out = marked.where("_hot").drop("_hot").join(few, key, how).unionByName(marked.where("_hot is null").drop("_hot").join(side, key, how))
    if how == "left":
        added = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema if f.name != key]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *added))
    return out
