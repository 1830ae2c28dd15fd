"""Resampling and rank statistics. Everything is reduced to sufficient statistics per cluster before it is resampled.

``bootstrap`` draws clusters with replacement by hashes of (seed, replicate, draw): conditions that share a cluster table
share their draws, which makes differences paired. Its cost is replicates times clusters, as digests made and added up in
Arrow batches. ``poisson_bootstrap`` weights every cluster independently in each replicate and needs no index and only
map-side sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.functions.hashing import draw_ints, uniform
from quillon.operators.sampling import hash_ranks
from quillon.session import stage


#: Clusters packed in one row; clusters whose sums a task holds, up to one such row more; draws and replicates of a task
#: at least, since all tasks of different replicates get the same clusters.
PACKED, HELD, DRAWS, LEAST = 1 << 16, 1 << 21, 1 << 22, 32


def bootstrap(clusters: DataFrame, group: list[str], cluster: str, sums: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """(group..., b, sums...): per replicate the sums over as many clusters as the group has, drawn with replacement.
    Rows without a group are left out; a null sum counts as 0.

    Clusters are numbered in the order of their digests, slice by slice, so no group is sorted by one task. They travel
    packed to tasks of some replicates each, where the draws are made once for all groups and added up: no draw is a row,
    and none is shuffled or broadcast. Beyond ``HELD`` clusters the draws are made again for each part."""
    ranked = hash_ranks(clusters.select(*group, cluster, *sums).dropna(subset=group) if group else clusters, group, cluster, None)
    packed = ranked.groupBy(*group, "of", F.floor((F.col("nth") - 1) / PACKED).alias("row_")).agg(F.count("*").alias("n_"), F.collect_list(F.struct("nth", *sums)).alias("rows_"))
    packed = stage(packed, "clusters")
    to = F.sum("n_").over(W.partitionBy(F.lit(1)).orderBy("of", *group, "row_"))  # without the packed values
    parts = packed.select(*group, "of", "row_", "n_").select(*group, "row_", F.floor((to - F.col("n_")) / HELD).alias("part_"))
    largest = packed.agg(F.max("of")).first()[0] or 1
    each = min(replicates, max(LEAST, -(-DRAWS // largest)))
    sent = packed.join(parts, [*group, "row_"]).select(
        *group, "of", "part_", *[F.col("rows_")[c].alias(c) for c in ("nth", *sums)], F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(each))).alias("first_")
    )
    kinds = {s: T.DoubleType() if isinstance(clusters.schema[s].dataType, T.FractionalType) else T.LongType() for s in sums}
    schema = T.StructType([*[clusters.schema[g] for g in group], T.StructField("b", T.IntegerType()), *[T.StructField(s, k) for s, k in kinds.items()]])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first = table["first_"][0].as_py()
        last, sizes, rows = min(first + each, replicates), table["of"].to_pylist(), {}
        for row, key in enumerate(zip(*[table[g].to_pylist() for g in group], sizes)):
            rows.setdefault(key, []).append(row)
        held = []
        for own in rows.values():
            flat = lambda c, own=own: np.concatenate([table[c][row].values.fill_null(0).to_numpy(zero_copy_only=False) for row in own])
            at = flat("nth") - 1
            low, size = at.min(), len(at)
            values = [np.zeros(size + 1, float if kind == T.DoubleType() else np.int64) for kind in kinds.values()]  # the last is for clusters held elsewhere
            for s, v in zip(sums, values):
                v[at - low] = flat(s)
            held.append((sizes[own[0]], low, size, values, [np.zeros(last - first, v.dtype) for v in values]))
        for b, j, ints in draw_ints(seed, first, last, max(sizes)):
            to = slice(b - first, b - first + len(ints))
            for k, low, size, values, totals in held:
                if j < k:
                    idx = ints[:, : k - j] % k
                    if size < k:
                        idx = np.where((idx >= low) & (idx < low + size), idx - low, size)
                    for v, total in zip(values, totals):
                        total[to] += v[idx].sum(axis=1)
        names = [table[g].take(pa.array(np.repeat([own[0] for own in rows.values()], last - first))) for g in group]
        bs = pa.array(np.tile(np.arange(first, last, dtype=np.int32), len(held)))
        return pa.Table.from_arrays([*names, bs, *[pa.array(np.concatenate(t)) for t in zip(*[x[-1] for x in held])]], names=[*group, "b", *sums])

    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or they would be merged while small
    drawn = sent.repartition(tasks, "part_", "first_").groupBy("part_", "first_").applyInArrow(run, schema)
    return drawn.groupBy(*group, "b").agg(*[F.sum(s).alias(s) for s in sums])


def poisson_bootstrap(clusters: DataFrame, group: list[str], cluster: str, sums: list[str], replicates: int, seed: int = 42) -> DataFrame:
    """As ``bootstrap`` with independent Poisson(1) weights per cluster and replicate (up to 8)."""
    cdf, term, cuts = 0.0, math.exp(-1), []
    for k in range(8):
        cdf += term
        term /= k + 1
        cuts.append(cdf)
    u = uniform(F.concat_ws("|", F.lit(f"p{seed}"), F.col("b"), F.col(cluster)))
    weighted = clusters.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", u)
    weight = F.lit(0)
    for c in cuts:
        weight = weight + (F.col("u") > c).cast("int")
    weighted = weighted.withColumn("w", weight).where("w > 0")
    return weighted.groupBy(*group, "b").agg(*[F.sum(F.col(s) * F.col("w")).alias(s) for s in sums])


def interval(x: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Percentile bounds (linear interpolation) of a statistic over replicates."""
    tail = (1 - level) / 2
    return F.percentile(x, F.lit(tail)), F.percentile(x, F.lit(1 - tail))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r as an aggregate; null without variance on both sides or with a single row."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def value_ranks(counts: DataFrame, group: list[str], value: str, n: str) -> DataFrame:
    """``counts``, one row per group and value with ``n`` rows each, with ``rank``, the mean rank of the value's rows.

    Values are cut into ranges; the sizes of the ranges before a value are added to its place within its own, so no group
    is sorted by one task. The ranges are staged, since they are read twice."""
    spark = counts.sparkSession
    ranged = counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, value).withColumn("part_", F.spark_partition_id())
    ranged = stage(ranged, "value-ranges")
    sizes = ranged.groupBy(*group, "part_").agg(F.sum(n).alias("k_"))
    before = sizes.select(*group, "part_", (F.sum("k_").over(W.partitionBy(*group).orderBy("part_")) - F.col("k_")).alias("before_"))  # a row per range
    inside = F.sum(n).over(W.partitionBy(*group, "part_").orderBy(value))
    ranked = ranged.withColumn("inside_", inside).join(before, [*group, "part_"])
    return ranked.withColumn("rank", F.col("before_") + F.col("inside_") - F.col(n) + (F.col(n) + 1) / 2.0).drop("part_", "before_", "inside_")


def average_ranks(df: DataFrame, group: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rows with a group and a value, and the rank of the value within the group, ties sharing their mean rank."""
    ranked = value_ranks(df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_")), group, value, "n_")
    return df.join(ranked.select(*group, value, F.col("rank").alias(out)), [*group, value])


def wilcoxon(diffs: DataFrame, group: list[str], d: str) -> DataFrame:
    """(group..., n, w_plus, w_minus, z): signed-rank statistic without zeros, normal approximation with tie correction.
    Rows are counted per size and sign before sizes are ranked."""
    used = diffs.where((F.col(d) != 0) & F.col(d).isNotNull())
    sizes = used.groupBy(*group, F.abs(d).alias("size_")).agg(F.count("*").alias("n_"), F.count_if(F.col(d) > 0).alias("plus_"))
    n_ = F.col("n_")
    out = value_ranks(sizes, group, "size_", "n_").groupBy(*group).agg(
        F.sum("n_").alias("n"),
        F.sum(F.col("rank") * F.col("plus_")).alias("w_plus"),
        F.sum(F.col("rank") * (n_ - F.col("plus_"))).alias("w_minus"),
        F.sum(n_ * (n_ * n_ - 1)).alias("correction_"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("correction_") / 48.0
    return out.withColumn("z", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var))).drop("correction_")


def mann_whitney(values: DataFrame, group: list[str], value: str, first: str) -> DataFrame:
    """(group..., n1, n2, u, z) of the rows where the boolean ``first`` holds against the others, counted per value before
    values are ranked."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n_"), F.count_if(first).alias("first_"))
    n_ = F.col("n_")
    out = value_ranks(counts, group, value, "n_").groupBy(*group).agg(
        F.sum("first_").alias("n1"), F.sum(n_ - F.col("first_")).alias("n2"), F.sum(F.col("rank") * F.col("first_")).alias("r1_"), F.sum(n_ * (n_ * n_ - 1)).alias("correction_")
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1_") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.col("correction_") / (n * (n - 1)))
    return out.withColumn("u", u).withColumn("z", F.when(var > 0, (u - n1 * n2 / 2) / F.sqrt(var))).drop("r1_", "correction_")


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of the discordant counts; 1 without any."""
    n, m = (b + c).cast("double"), F.least(b, c)
    start = F.struct((-n * F.lit(math.log(2))).alias("t"), F.exp(-n * F.lit(math.log(2))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.ln((n - i + 1) / i)
        return F.struct(t.alias("t"), (acc["s"] + F.exp(t)).alias("s"))

    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>")), start, step)["s"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def holm(df: DataFrame, family: list[str], p: str, order: list[str], monotone: bool = True, out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p-values; without ``monotone`` the running maximum is left out."""
    by = W.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(W.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(by) + 1) * F.col(p))
    df = df.withColumn(out, step)
    return df.withColumn(out, F.max(out).over(by.rowsBetween(W.unboundedPreceding, 0))) if monotone else df


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of k successes in n."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def equivalent(low: Column, high: Column, margin: float, closed: bool = False) -> Column:
    """Whether a 90 % interval lies inside the margin."""
    return ((low >= -margin) & (high <= margin)) if closed else ((low > -margin) & (high < margin))


#: 97.5 % quantiles of Student's t by degrees of freedom.
T_975 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228}


def t_half_width(sd: Column, n: Column) -> Column:
    """Half width of the 95 % interval of a mean; null for n = 1; 1.96 beyond ten degrees of freedom."""
    table = F.create_map(*[x for k, v in T_975.items() for x in (F.lit(k), F.lit(v))])
    return F.when(n > 1, F.coalesce(F.try_element_at(table, (n - 1).cast("int")), F.lit(1.96)) * sd / F.sqrt(n))


def normal_p(z: Column, two_sided: bool = True) -> Column:
    """p-value of a z score (complementary error function, Arrow batches)."""
    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else (1.0 if two_sided else 0.5) * math.erfc((abs(v) if two_sided else v) / math.sqrt(2)))

    return tail(z)
