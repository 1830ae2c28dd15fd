"""Data-quality gates: each gives one row (gate, ok, hard, observed, expected); ``enforce`` raises on a hard failure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = ("gate", "ok", "hard", "observed", "expected")


def gate(df: DataFrame, name: str, observed: Column, expected: Column, hard: bool = True, ok: Column | None = None) -> DataFrame:
    """A gate over one aggregate of ``df``; without ``ok`` the observed value must equal the expected one."""
    row = df.agg(observed.cast("string").alias("observed"), expected.cast("string").alias("expected"), (ok if ok is not None else F.lit(None).cast("boolean")).alias("ok_"))
    return row.select(F.lit(name).alias("gate"), F.coalesce("ok_", F.col("observed") == F.col("expected")).alias("ok"), F.lit(hard).alias("hard"), "observed", "expected")


def expect_rows(df: DataFrame, name: str, n: int, hard: bool = True) -> DataFrame:
    return gate(df, name, F.count("*"), F.lit(n), hard)


def expect_unique(df: DataFrame, name: str, keys: list[str], hard: bool = True) -> DataFrame:
    """Observed: keys that occur more than once."""
    return gate(df.groupBy(*keys).count(), name, F.count_if(F.col("count") > 1), F.lit(0), hard)


def expect_range(df: DataFrame, name: str, value: str, low: float, high: float, hard: bool = True) -> DataFrame:
    return gate(df, name, F.count_if(~F.col(value).between(low, high)), F.lit(0), hard)


def expect_lossless_join(a: DataFrame, b: DataFrame, name: str, keys: list[str], values: list[str], tolerance: float = 1e-9, hard: bool = True) -> DataFrame:
    """Observed: rows without a partner on either side plus rows whose values differ by more than the tolerance."""
    left = a.select(*keys, *[F.col(v).alias(f"l_{v}") for v in values], F.lit(1).alias("in_l"))
    right = b.select(*keys, *[F.col(v).alias(f"r_{v}") for v in values], F.lit(1).alias("in_r"))
    j = left.join(right, keys, "full_outer")
    bad = F.col("in_l").isNull() | F.col("in_r").isNull()
    for v in values:
        bad = bad | F.coalesce(F.abs(F.col(f"l_{v}") - F.col(f"r_{v}")) > tolerance, F.lit(False))
    return gate(j, name, F.count_if(bad), F.lit(0), hard)


def expect_same_set(a: DataFrame, b: DataFrame, name: str, hard: bool = True) -> DataFrame:
    """Observed: rows in exactly one of two sets."""
    return gate(a.subtract(b).unionAll(b.subtract(a)), name, F.count("*"), F.lit(0), hard)


def report(gates: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, gates).select(*_COLUMNS)


def enforce(gates: DataFrame) -> None:
    """Raise if a hard gate failed; the report has one row per gate."""
    failed = [r.gate for r in gates.where("hard and not ok").select("gate").collect()]
    if failed:
        raise AssertionError("gates failed: " + ", ".join(sorted(failed)))


def environment(spark: SparkSession) -> DataFrame:
    """Versions and settings, for the record."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled")
    return spark.createDataFrame([("spark.version", spark.version), *[(k, spark.conf.get(k)) for k in keys]], "key string, value string")


def expect_close(mine: DataFrame, golden: DataFrame, keys: list[str], value: str, kind: str, bounds: dict[str, float]) -> DataFrame:
    """(kind, n_cells, deviation, ok) per kind of ``mine(keys, value, kind)``: its cells, their largest distance from the
    golden table and whether that is within the kind's bound. A cell that only one table has makes its kind fail; cells
    that only the golden table has are of the kind null."""
    both = mine.select(*keys, kind, F.col(value).alias("mine_")).join(golden.select(*keys, F.col(value).alias("golden_")), keys, "full_outer")
    bound = F.coalesce(*[F.when(F.col(kind) == k, F.lit(b)) for k, b in bounds.items()], F.lit(-1.0))
    gap = F.abs(F.col("mine_") - F.col("golden_"))
    return both.groupBy(F.col(kind).alias("kind")).agg(
        F.count("*").alias("n_cells"), F.max(gap).alias("deviation"), F.bool_and(F.coalesce(gap <= bound, F.lit(False))).alias("ok")
    )


def expect_not_above(df: DataFrame, name: str, harsh: Column, mild: Column, buffer: float, hard: bool = True) -> DataFrame:
    """Observed: one aggregate; expected: at most the other and the buffer."""
    return gate(df, name, harsh, mild + buffer, hard, ok=harsh <= mild + buffer)
