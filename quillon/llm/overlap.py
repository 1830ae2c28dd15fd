"""Problem 1: the same or almost the same record in an evaluation split and in training.

Method: word n-gram hashes of the evaluation records, partitioned by hash, are scanned against those of the training
records, and the containment of each evaluation record in each training record it hits is computed from all their words.
Similarity here is that of word multisets, so the n-gram is one word with its occurrence number. Three things keep the
scan small without losing a pair:

* a hash also carries the coarse shape of the record's normalised series (a grid cell over a few positions; evaluation
  records probe every cell within the tolerance), so captions are only looked up where the series can match;
* only the rarest ``n - ceil(t*n) + 1`` tokens of a record are looked up: two sets of similarity t share one of them
  under any common order. The order puts a bounded list of the corpus' most frequent tokens last. In cells of many
  records, combinations of two or three of the rarest tokens are looked up instead, which similar records share too,
  and 128 parity bits of the tokens, carried along, refuse most pairs before they are compared;
* records that are equal in side, series and words form one class, so hot copies meet once and are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.session import stage

_SCHEMA = "id long, side int, len int, series_key binary, cells array<long>, n int, words_key binary, tokens array<long>"


def _normalised(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows brought to mean 0 and population standard deviation 1, and which rows can be (finite, not constant)."""
    finite = np.isfinite(block).all(axis=1)
    block = np.where(finite[:, None], block, 0.0)
    ok = finite & (block.max(axis=1) > block.min(axis=1))
    mean = block.mean(axis=1, keepdims=True)
    sd = block.std(axis=1, keepdims=True)
    ok &= sd[:, 0] > 0
    return (block - mean) / np.where(sd > 0, sd, 1.0), ok


def _cells(z: np.ndarray, probe: np.ndarray, tolerance: float, width: float, dims: int) -> list[np.ndarray]:
    """Grid cells of each normalised row; rows marked in ``probe`` get every cell within the tolerance."""
    length = z.shape[1]
    at = np.unique(np.linspace(0, length - 1, min(length, dims)).round().astype(int))
    slack = tolerance + 1e-9
    low = np.floor((z[:, at] - np.where(probe, slack, 0.0)[:, None]) / width).astype(np.int64)
    high = np.floor((z[:, at] + np.where(probe, slack, 0.0)[:, None]) / width).astype(np.int64)
    out: list[list[int]] = [[] for _ in range(len(z))]
    rows = np.arange(len(z))
    for mask in range(1 << len(at)):
        bits = np.array([mask >> d & 1 for d in range(len(at))], dtype=bool)
        sel = rows if not bits.any() else np.flatnonzero((low[:, bits] != high[:, bits]).all(axis=1))
        if not len(sel):
            continue
        cell = np.where(bits, high[sel], low[sel])
        code = np.full(len(sel), length, dtype=np.uint64)
        for d in range(len(at)):
            code = T.mix(code * np.uint64(31) + cell[:, d].astype(np.uint64))
        for r, c in zip(sel.tolist(), code.tolist()):
            out[r].append(c)
    return [np.array(x, dtype=np.uint64) for x in out]


def signatures(
    records: DataFrame, tolerance: float, width: float = 0.5, dims: int = 6
) -> DataFrame:
    """One row per usable record of ``records(id, side, series, caption)``: grid cells, word tokens and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = T.WordCodes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            side = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            series = batch.column(2)
            flat, counts = T.flat_words(batch.column(3), codes)
            tokens = T.multiset_tokens(flat, counts)
            values = series.values.to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = series.offsets.to_numpy()
            lengths = np.where(series.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
            usable = np.zeros(len(ids), dtype=bool)
            key = np.zeros((len(ids), 16), dtype=np.uint8)
            cells: list[np.ndarray] = [np.zeros(0, dtype=np.uint64)] * len(ids)
            for length in np.unique(lengths[(lengths > 1) & (counts > 0)]):
                rows = np.flatnonzero((lengths == length) & (counts > 0))
                block = values[offsets[rows][:, None] + np.arange(length)]
                z, ok = _normalised(block)
                rows, block, z = rows[ok], block[ok], z[ok]
                if not len(rows):
                    continue
                usable[rows] = True
                key[rows] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in block), np.uint8).reshape(-1, 16)
                for r, c in zip(rows.tolist(), _cells(z, side[rows] == 1, tolerance, width, dims)):
                    cells[r] = c
            digest = T.row_digest(tokens, counts)
            tokens, counts = T.keep_rows(tokens, counts, usable)
            kept = [c for c, u in zip(cells, usable) if u]
            n_cells = np.array([len(c) for c in kept], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    T.longs(ids[usable]),
                    pa.array(side[usable]),
                    pa.array(lengths[usable].astype(np.int32)),
                    T.binaries(key[usable].view(np.uint64)),
                    T.long_lists(np.concatenate([np.zeros(0, np.uint64), *kept]), n_cells),
                    pa.array(counts.astype(np.int32)),
                    digest.filter(pa.array(usable)),
                    T.long_lists(tokens, counts),
                ],
                names=["id", "side", "len", "series_key", "cells", "n", "words_key", "tokens"],
            )

    return records.select("id", "side", "series", "caption").mapInArrow(run, _SCHEMA)


def schemes_of(n: int, threshold: float, bounds: tuple[tuple[int, int], ...]) -> list[tuple[int, int, bool]]:
    """The lookups a record of n words takes part in, as (scheme, tokens per key, own).

    Scheme k serves the pairs whose larger record has more words than bound k-1 and at most bound k; such a pair shares
    ceil(t * larger) words, of which every key takes some. A record is ``own`` in the scheme of its size; in a higher one
    that its similar records may reach it only meets records that are own there."""
    out, low = [], 0
    for k, (high, size) in enumerate((*bounds, (1 << 62, 1))):
        if n <= high and (n > low or n >= threshold * (low + 1) - 1e-9):
            out.append((k, size, n > low))
        low = high
    return out


def parity_bits(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per row, each the parity of the tokens that fall on it. Rows whose bits differ in d places differ in at
    least d tokens."""
    bit = np.uint64(1) << (tokens & np.uint64(63))
    upper = (tokens & np.uint64(64)) != 0
    starts = np.cumsum(counts) - counts
    if not len(tokens):
        return np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
    zero = np.uint64(0)
    return np.bitwise_xor.reduceat(np.where(upper, zero, bit), starts), np.bitwise_xor.reduceat(np.where(upper, bit, zero), starts)


def _rare_grams(classes: DataFrame, threshold: float, frequent: list[int], bounds: tuple[tuple[int, int], ...]) -> DataFrame:
    """(rep, side, n, cells, low, high, single, joint): the parity bits and keys by which each class is looked up, made of its rarest tokens.

    ``single``, for cells of few records: the first n - ceil(t*n) + 1 tokens, of which two similar records share one.
    ``joint``, for hot cells: all combinations of ``size`` tokens among the first n - ceil(t*n) + size, by the schemes of
    ``schemes_of``; two similar records share such a combination too, and others hardly ever do."""
    common = np.array(frequent, dtype=np.int64)[::-1]
    by_value = np.argsort(common)
    common_sorted = common[by_value]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks: dict[tuple[int, int], np.ndarray] = {}
        plans: dict[int, list[tuple[int, int, bool]]] = {}
        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            counts = np.diff(batch.column(0).offsets.to_numpy()).astype(np.int64)
            hot = batch.column(1).to_numpy(zero_copy_only=False)
            side = batch.column(3).to_numpy(zero_copy_only=False)
            rank = np.zeros(len(tokens), dtype=np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common_sorted, tokens), len(common) - 1)
                rank = np.where(common_sorted[at] == tokens, by_value[at] + 1, 0)
            row = np.repeat(np.arange(len(counts)), counts)
            tokens = tokens[np.lexsort((tokens, rank, row))]
            need = np.ceil(threshold * counts - 1e-9).astype(np.int64)
            start = np.cumsum(counts) - counts
            nth = np.arange(len(tokens)) - np.repeat(start, counts)
            prefix = np.minimum(counts - need + 1, counts)
            single = tokens[nth < np.repeat(prefix, counts)]
            low, high = parity_bits(tokens.view(np.uint64), counts)
            joint, sizes = [np.zeros(0, np.uint64)], np.zeros(len(counts), np.int64)
            for r in np.flatnonzero(hot).tolist():
                n = int(counts[r])
                if n not in plans:
                    plans[n] = schemes_of(n, threshold, bounds)
                for k, size, own in plans[n]:
                    width = n - max(int(need[r]), size) + size
                    if (width, size) not in picks:
                        picks[(width, size)] = np.array(list(combinations(range(width), size)), dtype=np.int64)
                    chosen = tokens[start[r] + picks[(width, size)]].view(np.uint64)
                    key = np.full(len(chosen), k + 1, dtype=np.uint64)
                    for c in range(size):
                        key = T.mix(key * np.uint64(31) + chosen[:, c])
                    # 1: both own; 2: the evaluation record is own, the training record is not; 3: the other way round
                    for role in ((1, 2 + int(side[r] == 0)) if own else (2 + int(side[r] == 1),)):
                        joint.append(key + np.uint64(role))
                        sizes[r] += len(key)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], T.longs(low), T.longs(high), T.long_lists(single, prefix), T.long_lists(np.concatenate(joint), sizes)],
                names=["rep", "side", "n", "cells", "low", "high", "single", "joint"],
            )

    cells = "cells array<struct<cell:long,hot:boolean>>"
    return classes.select("tokens", F.exists("cells", lambda c: c["hot"]).alias("hot"), "rep", "side", "n", "cells").mapInArrow(
        run, f"rep long, side int, n int, {cells}, low long, high long, single array<long>, joint array<long>"
    )


def _series_within(pairs: DataFrame, series: DataFrame, tolerance: float, small: int) -> DataFrame:
    """Those of ``pairs(eval_rep, train_rep)`` whose normalised series differ by no more than the tolerance.

    Only the series of records in the pairs are moved. Their identifiers filter the scan as a broadcast while there
    are at most ``small`` of them (counted first), else through a shuffle."""
    needed = pairs.select(F.explode(F.array("eval_rep", "train_rep")).alias("id")).distinct()
    needed = stage(needed, "p1-needed")
    if needed.count() <= small:
        needed = F.broadcast(needed)
    held = series.join(needed, "id", "left_semi")
    both = pairs.join(held.select(F.col("id").alias("eval_rep"), F.col("series").alias("x")), "eval_rep").join(
        held.select(F.col("id").alias("train_rep"), F.col("series").alias("y")), "train_rep"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
            lengths = np.diff(sides[0][1])
            keep = np.zeros(len(lengths), dtype=bool)
            for length in np.unique(lengths):
                same = np.flatnonzero(lengths == length)
                for k in range(0, len(same), 512):
                    rows = same[k : k + 512]
                    (x, ok), (y, fine) = (_normalised(values[offsets[rows][:, None] + np.arange(length)]) for values, offsets in sides)
                    keep[rows] = ok & fine & (np.abs(x - y).max(axis=1) <= tolerance)
            yield batch.select(["eval_rep", "train_rep"]).filter(pa.array(keep))

    return both.select("eval_rep", "train_rep", "x", "y").mapInArrow(run, "eval_rep long, train_rep long")


def cross_split_overlaps(
    records: DataFrame,
    id_col: str = "pair_no",
    split_col: str = "split",
    series_col: str = "series",
    caption_col: str = "caption",
    train: tuple[str, ...] = ("train",),
    evaluation: tuple[str, ...] = ("val", "test"),
    threshold: float = 0.6,
    tolerance: float = 0.05,
    frequent: int = 4096,
    hot_cell: int = 1000,
    bounds: tuple[tuple[int, int], ...] = ((1, 1), (3, 2), (12, 3), (64, 2)),
    small: int = 1_000_000,
) -> DataFrame:
    """All (eval_id, train_id, n_hits, containment, similarity) of records found in both an evaluation and a train split.

    A pair qualifies if its series have the same length and, normalised, differ nowhere by more than ``tolerance``,
    and the word multisets of its captions have a similarity of at least ``threshold``. ``n_hits`` counts the words
    they share; ``containment`` is that number over the words of the evaluation record.

    Defined cases: null, constant or non-finite series (a null within a series counts as non-finite), captions without
    words and null or other splits match nothing; repeated rows each give their own pairs; an empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    source = records.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(split_col).isin(*train), 0).when(F.col(split_col).isin(*evaluation), 1).cast("int").alias("side"),
        F.col(series_col).cast("array<double>").alias("series"),
        F.col(caption_col).cast("string").alias("caption"),
    ).where("side is not null and series is not null and caption is not null")
    held = stage(signatures(source, tolerance), "p1-signatures")
    same = ["side", "len", "series_key", "words_key"]
    classes = held.groupBy(*same).agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.first("cells").alias("cells"), F.first("tokens").alias("tokens")
    )
    # keep classes whose cell occurs on the other side too; cells of many rows are hot
    per_cell = held.select("side", F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.bit_or(F.expr("shiftleft(1, side)")).alias("sides"), (F.count("*") > hot_cell).alias("hot")
    )
    shared = per_cell.where("sides = 3").select("cell", "hot")
    live = classes.select("rep", F.explode("cells").alias("cell")).join(shared, "cell").groupBy("rep").agg(
        F.collect_list(F.struct("cell", "hot")).alias("cells")
    )
    live = stage(classes.drop("cells").join(live, "rep"), "p1-classes")
    top = (
        live.select(F.explode("tokens").alias("t")).groupBy("t").count().orderBy(F.desc("count"), "t").limit(frequent).select("t").collect()
    )  # a list of bounded length, however large the corpus
    spread = _rare_grams(live, threshold, [r.t for r in top], bounds).withColumn("c", F.explode("cells"))
    gram = F.explode(F.when(F.col("c.hot"), F.col("joint")).otherwise(F.col("single")))
    sizes = ("n", "low", "high")
    grams = spread.select("rep", "side", *sizes, "c", gram.alias("gram")).select("rep", "side", *sizes, F.xxhash64("c.cell", "gram").alias("key"))
    left = grams.where("side = 1").select("key", F.col("rep").alias("eval_rep"), *[F.col(c).alias(f"e_{c}") for c in sizes])
    right = grams.where("side = 0").select("key", F.col("rep").alias("train_rep"), *[F.col(c).alias(f"t_{c}") for c in sizes])
    # what may differ at most between two records of these sizes, against what differs at least
    apart = F.expr("bit_count(e_low ^ t_low) + bit_count(e_high ^ t_high)")
    hits = (
        left.join(right, "key")
        .where(F.least("e_n", "t_n") >= threshold * F.greatest("e_n", "t_n") - 1e-9)
        .where(apart <= (F.col("e_n") + F.col("t_n")) * ((1 - threshold) / (1 + threshold)) + 1e-9)
        .select("eval_rep", "train_rep")
        .distinct()
    )
    e = live.where("side = 1").select(
        F.col("rep").alias("eval_rep"), F.col("tokens").alias("et"), F.col("n").alias("en"), F.col("series_key").alias("ek"), F.col("len").alias("el")
    )
    t = live.where("side = 0").select(
        F.col("rep").alias("train_rep"), F.col("tokens").alias("tt"), F.col("n").alias("tn"), F.col("series_key").alias("tk"), F.col("len").alias("tl")
    )
    scored = (
        hits.join(e, "eval_rep")
        .join(t, "train_rep")
        .where("el = tl")
        .withColumn("n_hits", F.size(F.array_intersect("et", "tt")))
        .where(F.col("n_hits") >= threshold * (F.col("en") + F.col("tn") - F.col("n_hits")) - 1e-9)
        .select("eval_rep", "train_rep", "n_hits", "en", "tn", "ek", "tk")
    )
    scored = stage(scored, "p1-scored")
    # every pair of different series is compared once, however many captions it has
    differing = stage(scored.where("ek <> tk").groupBy("ek", "tk").agg(F.min_by(F.struct("eval_rep", "train_rep"), F.struct("eval_rep", "train_rep")).alias("p")).select("ek", "tk", "p.*"), "p1-series")
    close = _series_within(differing.select("eval_rep", "train_rep"), source.select("id", "series"), tolerance, small)
    close = differing.join(close, ["eval_rep", "train_rep"]).select("ek", "tk")
    good = scored.where("ek = tk").unionByName(scored.where("ek <> tk").join(close, ["ek", "tk"]))
    member = classes.select("rep", *same).join(held.select("id", *same), same).select("rep", "side", "id")
    return (
        good.join(member.where("side = 1").select(F.col("rep").alias("eval_rep"), F.col("id").alias("eval_id")), "eval_rep")
        .join(member.where("side = 0").select(F.col("rep").alias("train_rep"), F.col("id").alias("train_id")), "train_rep")
        .select(
            "eval_id",
            "train_id",
            "n_hits",
            (F.col("n_hits") / F.col("en")).alias("containment"),
            (F.col("n_hits") / (F.col("en") + F.col("tn") - F.col("n_hits"))).alias("similarity"),
        )
    )


def overlap_report(records: DataFrame, overlaps: DataFrame, id_col: str = "pair_no") -> DataFrame:
    """Per split and dataset of the evaluation records: how many were found in training, in how many pairs, and the
    largest and mean containment."""
    per_eval = overlaps.groupBy("eval_id").agg(
        F.count("*").alias("n_pairs"), F.max("containment").alias("best")
    )
    return (
        records.select(F.col(id_col).alias("eval_id"), "split", "dataset")
        .where(F.col("split").isin("val", "test"))
        .join(per_eval, "eval_id", "left")
        .groupBy("split", "dataset")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("best").alias("n_leaked"),
            F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs"),
            F.round(F.avg("best"), 6).alias("mean_containment"),
        )
    )
