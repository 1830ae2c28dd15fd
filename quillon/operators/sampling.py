"""Seeded samples and splits: order by ``md5(seed|key)`` instead of a generator, so results survive repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def hash_key(key: Column, seed: str | None) -> Column:
    """Digest of ``seed|key``, or of the key alone."""
    return F.md5(F.concat_ws("|", F.lit(seed), key) if seed is not None else key.cast("string"))


def hash_ranks(df: DataFrame, group: list[str], key: str, seed: str | None = "42") -> DataFrame:
    """Columns ``nth`` and ``of``: each row's place in its group by hash order (ties by key), and the group's size.

    Places are counted within 256 ranges of the hash, to which the sizes of the ranges before are added, so that a group
    with a third of all rows is not sorted by one task. Null group values form a group of their own."""
    keyed = df.withColumn("digest_", hash_key(F.col(key), seed)).withColumn("slice_", F.substring("digest_", 1, 2))
    counts = keyed.groupBy(*group, "slice_").agg(F.count("*").alias("n_"))
    within = W.partitionBy(*(group or [F.lit(1)]))
    counts = counts.select(
        *[F.col(g).alias(f"g{i}_") for i, g in enumerate(group)],
        F.col("slice_").alias("s_"),
        (F.sum("n_").over(within.orderBy("slice_")) - F.col("n_")).alias("before_"),
        F.sum("n_").over(within).alias("of"),
    )
    place = F.row_number().over(W.partitionBy(*group, "slice_").orderBy("digest_", key))
    same = F.col("slice_") == F.col("s_")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"g{i}_"))
    ranked = keyed.withColumn("place_", place).join(counts, same).withColumn("nth", (F.col("place_") + F.col("before_")).cast("long"))
    return ranked.drop("digest_", "slice_", "place_", "before_", "s_", *[f"g{i}_" for i in range(len(group))])


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int | str, seed: str = "42") -> DataFrame:
    """At most n rows (a number or a column) of each group, without replacement; all rows of a smaller group.

    A number plans as a group limit before the shuffle; a column goes through ``hash_ranks``."""
    if isinstance(n, str):
        return hash_ranks(df, group, key, seed).withColumnRenamed("nth", "pick").where(F.col("pick") <= F.col(n)).drop("of")
    rank = F.row_number().over(W.partitionBy(*group).orderBy(hash_key(F.col(key), seed), key))
    return df.withColumn("pick", rank).where(F.col("pick") <= n)


def stratified_split(df: DataFrame, strata: list[str], key: str, seed: str = "42") -> DataFrame:
    """Column ``new_split``: 8:1:1 per stratum by hash order, at least one row each in val and test if there are three."""
    held = F.greatest(F.lit(1), F.floor(F.col("of") / 10))
    split = F.when(F.col("of") < 3, "train").when(F.col("nth") <= held, "test").when(F.col("nth") <= 2 * held, "val").otherwise("train")
    return hash_ranks(df, strata, key, seed).withColumn("new_split", split).drop("nth", "of")


def interleave(df: DataFrame, strata: list[str], key: str, seed: str = "42") -> DataFrame:
    """Column ``position``: fractional rank within the stratum; in its order every prefix is stratified."""
    return hash_ranks(df, strata, key, seed).withColumn("position", (F.col("nth") - 0.5) / F.col("of")).drop("nth", "of")
