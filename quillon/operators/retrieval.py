"""Ranking queries against a pool of vectors, and retrieval metrics.

``rank_against_pool`` never builds the score matrix: queries and pool are cut into blocks of bounded size, each pair of
blocks yields only counts per query (members scoring higher, members scoring equal, ...), and counts add up across
blocks. Scores within ``EPS`` count as equal, so ranks do not depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions.arrays import dot
from quillon.functions.numbers import rounded

EPS = 1e-9
BLOCK = 2048


def blocks(vectors: DataFrame, n_rows: int, prefix: str, by: str | None = None) -> DataFrame:
    """One row per block of about BLOCK vectors: (``prefix``_block, ``prefix``s: array<struct<id, vec>>), of one value
    of ``by`` each if that is given."""
    n = max(1, -(-n_rows // BLOCK))
    keys = [by] if by else []
    return (
        vectors.groupBy(*keys, F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{prefix}_block"))
        .agg(F.collect_list(F.struct("id", "vec", *[c for c in vectors.columns if c not in ("id", "vec", by)])).alias(f"{prefix}s"))
    )


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], dict[str, np.ndarray]]]:
    """The pairs of blocks in columns 0 and 1, each as arrays by field; ``vec`` is a matrix. Nothing is copied on the way
    but strings."""

    def block(lists: pa.ListArray, at: int) -> dict[str, np.ndarray]:
        a, b = lists.offsets[at].as_py(), lists.offsets[at + 1].as_py()
        rows, out = lists.values, {}
        for field in rows.type:
            column = rows.field(field.name)
            if field.name == "vec":
                begin, end = column.offsets[a].as_py(), column.offsets[b].as_py()
                out["vec"] = column.values[begin:end].to_numpy(zero_copy_only=False).reshape(b - a, -1)
            else:
                out[field.name] = column.slice(a, b - a).to_numpy(zero_copy_only=False)
        return out

    for batch in batches:
        for k in range(batch.num_rows):
            yield block(batch.column(0), k), block(batch.column(1), k)


def rank_against_pool(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, n_greater, n_equal, n_before) of ``queries(id, gt, vec)`` against ``pool(id, vec)`` by dot product.

    n_equal leaves out the ground truth itself; n_before counts the equal members with a smaller id. Competition rank is
    1 + n_greater, average rank 1 + n_greater + n_equal / 2, positional rank 1 + n_greater + n_before. Queries whose
    ground truth is not in the pool are left out.
    """
    truth = queries.join(pool.select(F.col("id").alias("gt"), F.col("vec").alias("gv")), "gt").select(
        "id", "vec", "gt", dot(F.col("vec"), F.col("gv")).alias("s")
    )
    q = blocks(truth, queries.count(), "query")
    p = blocks(pool.select("id", "vec"), pool.count(), "member")

    kind = queries.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _pairs(batches):
            gap = left["vec"] @ right["vec"].T
            gap -= left["s"][:, None]
            # the ground truth itself, if it is in this block, counts as neither
            where = {x: k for k, x in enumerate(right["id"].tolist())}
            own = np.array([where.get(x, -1) for x in left["gt"].tolist()])
            here = np.flatnonzero(own >= 0)
            gap[here, own[here]] = -np.inf
            greater = (gap > EPS).sum(axis=1)
            row, col = np.nonzero(np.abs(gap) <= EPS)
            equal = np.bincount(row, minlength=len(gap))
            before = np.bincount(row[right["id"][col] < left["gt"][row]], minlength=len(gap))
            yield pa.RecordBatch.from_arrays([pa.array(left["id"]), *[pa.array(x.astype(np.int64)) for x in (greater, equal, before)]], names=["query_id", "g", "e", "b"])

    pairs = q.crossJoin(p)  # blocks, not rows
    counts = pairs.select("querys", "members").mapInArrow(run, f"query_id {kind}, g long, e long, b long")
    return counts.groupBy("query_id").agg(F.sum("g").alias("n_greater"), F.sum("e").alias("n_equal"), F.sum("b").alias("n_before"))


def top_members(queries: DataFrame, pool: DataFrame, k: int, keep_self: bool = False) -> DataFrame:
    """(query_id, member_id, score, rank): the k best pool members of each query, ties by smaller id. Each pair of blocks
    keeps k rows per query, so what is shuffled is bounded by k times the number of pool blocks."""
    q = blocks(queries.select("id", "vec"), queries.count(), "query")
    p = blocks(pool.select("id", "vec"), pool.count(), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _pairs(batches):
            order = np.argsort(right["id"], kind="stable")
            pid = right["id"][order]
            s = np.round(left["vec"] @ right["vec"][order].T, 9)
            if not keep_self:
                where = {x: n for n, x in enumerate(pid.tolist())}
                own = np.array([where.get(x, -1) for x in left["id"].tolist()])
                here = np.flatnonzero(own >= 0)
                s[here, own[here]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            score = np.take_along_axis(s, best, 1).ravel()
            found = np.isfinite(score)
            columns = [np.repeat(left["id"], best.shape[1])[found], pid[best.ravel()][found], score[found]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "member_id", "score"])

    kind = queries.schema["id"].dataType.simpleString()
    rows = q.crossJoin(p).select("querys", "members").mapInArrow(run, f"query_id {kind}, member_id {kind}, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "member_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_by_label(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, label, best): each query's best score among the members of every label of ``pool(id, vec, label)``, itself
    and members without a label left out. Each pair of blocks gives one row per query and label; scores are never listed."""
    q = blocks(queries.select("id", "vec"), queries.count(), "query")
    p = blocks(pool.where("label is not null").select("id", "vec", "label"), pool.count(), "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _pairs(batches):
            labels, code = np.unique(right["label"], return_inverse=True)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(labels)))
            s = np.round(left["vec"] @ right["vec"][order].T, 9)
            s[left["id"][:, None] == right["id"][order][None, :]] = -np.inf
            best = np.maximum.reduceat(s, starts, axis=1).ravel()
            found = np.isfinite(best)
            columns = [np.repeat(left["id"], len(labels))[found], np.tile(labels, len(s))[found], best[found]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "label", "best"])

    kinds = f"query_id {queries.schema['id'].dataType.simpleString()}, label {pool.schema['label'].dataType.simpleString()}, best double"
    rows = q.crossJoin(p).select("querys", "members").mapInArrow(run, kinds)
    return rows.groupBy("query_id", "label").agg(F.max("best").alias("best"))


def batch_logsumexp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, lse) of every row of ``rows: array<struct<label, vec>>``: the log-sum-exp of its scores in its batch."""
    for batch in batches:
        lists = batch.column(0)
        labels, vectors, offsets = lists.values.field("label"), lists.values.field("vec"), lists.offsets.to_numpy()
        values, at = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
        for a, b in zip(offsets[:-1], offsets[1:]):
            x = values[at[a] : at[b]].reshape(b - a, -1)
            s = x @ x.T
            top = s.max(axis=1)
            yield pa.RecordBatch.from_arrays([labels.slice(a, b - a), pa.array(np.log(np.exp(s - top[:, None]).sum(axis=1)) + top)], names=["label", "lse"])


def competition_rank() -> Column:
    return (1 + F.col("n_greater")).cast("long")


def average_rank() -> Column:
    return 1 + F.col("n_greater") + F.col("n_equal") / 2.0


def positional_rank() -> Column:
    return (1 + F.col("n_greater") + F.col("n_before")).cast("long")


def metrics(rank: str = "rank", cuts: tuple[int, ...] = (1, 5, 10)) -> list[Column]:
    """n, MRR, recall at the cut-offs and median of a rank column, as aggregates."""
    r = F.col(rank)
    return [
        F.count(r).alias("n"),
        rounded(F.avg(1 / r), 6).alias("mrr"),
        *[rounded(F.avg((r <= k).cast("double")), 6).alias(f"r_at_{k}") for k in cuts],
        F.median(r).cast("double").alias("median_rank"),
    ]


def chance(n: Column) -> list[Column]:
    """Chance level of a pool of n: MRR H(n)/n, recall 1/n and min(10, n)/n."""
    harmonic = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    return [F.round(harmonic / n, 9).alias("chance_mrr"), F.round(1.0 / n, 9).alias("chance_r_at_1"), F.round(F.least(F.lit(10), n) / n, 9).alias("chance_r_at_10")]


def average_precision(ranked: DataFrame, relevance: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ap): average precision at k of ``ranked(query_id, rank, rel)``, normalised by min(R, k) with
    ``relevance(query_id, n_relevant)``; 0 where nothing is relevant."""
    order = W.partitionBy("query_id").orderBy("rank")
    hits = ranked.where(F.col("rank") <= k).withColumn("cum", F.sum("rel").over(order))
    gained = hits.groupBy("query_id").agg(F.sum(F.col("rel") * F.col("cum") / F.col("rank")).alias("gain"))
    return relevance.join(gained, "query_id", "left").select(
        "query_id",
        F.when(F.col("n_relevant") > 0, F.coalesce("gain", F.lit(0.0)) / F.least("n_relevant", F.lit(k))).otherwise(0.0).alias("ap"),
    )
