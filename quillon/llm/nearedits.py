"""Problem 2: groups of records that differ by small edits, insertions or reordering.

Method: b-bit MinHash. Each distinct word multiset gets ``bands * rows`` minima; bands of ``rows`` minima generate the
candidates; of every minimum only the low ``bits`` bits are kept, packed into longs, and the similarity of a candidate
is estimated from the number of equal bit groups, corrected for chance agreement. Candidates whose estimate is not
clearly below the threshold are compared exactly. Records with equal word multisets form one class and are compared
once.

With 56 bands of 8 rows a pair of similarity 0.8 is missed with probability (1 - 0.8**8)**56 = 3.4e-5 at most, and the
estimate (448 groups of 2 bits, standard error 0.023) is allowed five standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import text as T
from quillon.llm.components import components
from quillon.session import stage


def word_sets(records: DataFrame, min_words: int) -> DataFrame:
    """(rec, words_key, n, tokens) of the records ``(rec, text)`` with at least ``min_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = T.WordCodes()
        for batch in batches:
            flat, counts = T.flat_words(batch.column(1), codes)
            keep = counts >= min_words
            flat, kept = T.keep_rows(flat, counts, keep)
            tokens = T.multiset_tokens(flat, kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).filter(pa.array(keep)),
                    T.row_digest(tokens, kept),
                    pa.array(kept.astype(np.int32)),
                    T.long_lists(tokens, kept),
                ],
                names=["rec", "words_key", "n", "tokens"],
            )

    return records.select("rec", "text").mapInArrow(run, "rec string, words_key binary, n int, tokens array<long>")


def _minima(tokens: np.ndarray, counts: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Minima of ``size`` hash functions over the tokens of each row, as uint32."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), size), dtype=np.uint32)
    for k in range(size):
        h = ((tokens * factors[k] + shifts[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, k] = np.minimum.reduceat(h, starts) if len(h) else 0
    return out


def signatures(sets: DataFrame, bands: int, rows: int, bits: int, seed: int) -> DataFrame:
    """(set_key, n, tokens, packed, keys): packed low bits of the minima and one hash per band."""
    per_long = 64 // bits
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            minima = _minima(T.mix(tokens), counts, size, seed)
            n = len(counts)
            low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint64)
            low = np.pad(low, ((0, 0), (0, -size % per_long))).reshape(n, -1, per_long)
            packed = (low << (np.arange(per_long, dtype=np.uint64) * np.uint64(bits))).sum(axis=2, dtype=np.uint64)
            keys = np.full((n, bands), 7, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)
            split = minima.reshape(n, bands, rows).astype(np.uint64)
            for r in range(rows):
                keys = T.mix(keys * np.uint64(0x9E3779B97F4A7C15) + split[:, :, r])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    T.long_lists(packed.ravel(), np.full(n, packed.shape[1])),
                    T.long_lists(keys.ravel(), np.full(n, bands)),
                ],
                names=["set_key", "n", "tokens", "packed", "keys"],
            )

    return sets.select("set_key", "n", "tokens").mapInArrow(
        run, "set_key long, n int, tokens array<long>, packed array<long>, keys array<long>"
    )


def estimate(a: Column, b: Column, size: int, bits: int) -> Column:
    """Similarity estimated from packed signatures: equal bit groups, corrected for chance agreement."""
    per_long = 64 // bits
    if bits not in (1, 2, 4):
        raise ValueError("bits must be 1, 2 or 4")
    spread = sum(1 << (k * bits) for k in range(per_long))
    spread -= 1 << 64 if spread >> 63 else 0
    differing = None
    for i in range(-(-size // per_long)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_bit = x
        for s in range(1, bits):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        count = F.bit_count(any_bit.bitwiseAND(F.lit(spread)))
        differing = count if differing is None else differing + count
    chance = 2.0**-bits
    return ((1 - differing / F.lit(float(size))) - chance) / (1 - chance)


def near_duplicate_sets(
    sets: DataFrame, threshold: float, bands: int, rows: int, bits: int, seed: int, slack: float, block: int = 2000, small: int = 1_000_000
) -> DataFrame:
    """(a, b, similarity) with a < b over distinct word multisets ``sets(set_key, n, tokens)``."""
    size = bands * rows
    signed = stage(signatures(sets, bands, rows, bits, seed), "p2-signatures")
    entry = signed.select("set_key", "n", F.explode("keys").alias("key"))
    # band keys of many sets: their pairs are spread over blocks times blocks
    hot = stage(entry.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > block).select("key", F.ceil(F.col("k") / block).cast("int").alias("blocks")), "p2-hot")
    listed = F.broadcast(hot) if hot.count() <= small else hot
    cold = entry.join(listed.select("key"), "key", "left_anti").withColumns({"i": F.lit(0), "j": F.lit(0)})
    warm = entry.join(listed, "key").withColumn("own", F.pmod(F.xxhash64("set_key"), "blocks").cast("int"))
    left = warm.select("set_key", "n", "key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = warm.select("set_key", "n", "key", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        both = x.select("key", "i", "j", F.col("set_key").alias("a"), F.col("n").alias("na")).join(y.select("key", "i", "j", F.col("set_key").alias("b"), F.col("n").alias("nb")), ["key", "i", "j"])
        both = both.where(((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9))
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    hit = meet(cold, cold).unionByName(meet(left, right)).distinct()
    near = (
        hit.join(signed.select(F.col("set_key").alias("a"), F.col("packed").alias("pa")), "a")
        .join(signed.select(F.col("set_key").alias("b"), F.col("packed").alias("pb")), "b")
        .where(estimate(F.col("pa"), F.col("pb"), size, bits) >= threshold - slack)
        .select("a", "b")
    )
    return (
        near.join(signed.select(F.col("set_key").alias("a"), F.col("tokens").alias("ta"), F.col("n").alias("na")), "a")
        .join(signed.select(F.col("set_key").alias("b"), F.col("tokens").alias("tb"), F.col("n").alias("nb")), "b")
        .withColumn("both", F.size(F.array_intersect("ta", "tb")))
        .withColumn("similarity", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))
        .where(F.col("similarity") >= threshold - 1e-9)
        .select("a", "b", "similarity")
    )


def near_edits(
    records: DataFrame,
    min_words: int = 20,
    threshold: float = 0.8,
    bands: int = 56,
    rows: int = 8,
    bits: int = 2,
    seed: int = 11,
    slack: float = 0.115,
    block: int = 2000,
) -> tuple[DataFrame, DataFrame]:
    """Members ``(rec, set_key)`` and links ``(a, b, similarity)`` between different word multisets of ``(rec, text)``.

    Records with fewer than ``min_words`` words, null or blank texts belong to nothing. Records with equal word
    multisets share a set_key: they are linked with similarity 1 without being listed pairwise. No candidate is capped.
    An empty table gives empty results; columns other than rec and text are ignored.
    """
    held = stage(word_sets(records, min_words), "p2-words")
    sets = held.groupBy("words_key").agg(F.min("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = stage(sets.withColumn("set_key", F.monotonically_increasing_id()), "p2-sets")  # fixed once written
    links = stage(near_duplicate_sets(sets.drop("words_key"), threshold, bands, rows, bits, seed, slack, block), "p2-links")
    return held.select("rec", "words_key").join(sets.select("words_key", "set_key"), "words_key").select("rec", "set_key"), links


def near_edit_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (rec_a, rec_b) of records, rec_a < rec_b: equal word multisets, and linked ones."""
    copies = members.select("set_key", F.col("rec").alias("x")).join(members.select("set_key", F.col("rec").alias("y")), "set_key").where("x < y")
    linked = (
        links.select("a", "b")
        .join(members.select(F.col("set_key").alias("a"), F.col("rec").alias("x")), "a")
        .join(members.select(F.col("set_key").alias("b"), F.col("rec").alias("y")), "b")
    )
    both = copies.select("x", "y").unionByName(linked.select("x", "y"))
    return both.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))


def near_edit_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row per record that is near another: its group (named by the group's smallest record), and the number of linked
    sets and of records with the same words."""
    label = components(links).select(F.col("node").cast("long").alias("set_key"), F.col("root").cast("long").alias("root"))
    degree = links.select(F.explode(F.array("a", "b")).alias("set_key")).groupBy("set_key").agg(F.count("*").alias("n_links"))
    sets = members.groupBy("set_key").agg(F.count("*").alias("n_copies"), F.min("rec").alias("least"))
    sets = sets.join(label, "set_key", "left").join(degree, "set_key", "left").where("root is not null or n_copies > 1")
    sets = stage(sets.withColumn("root", F.coalesce("root", "set_key")), "p2-grouped")
    named = sets.join(sets.groupBy("root").agg(F.min("least").alias("group_id")), "root")
    return members.join(named, "set_key").select("rec", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
