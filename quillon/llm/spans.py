"""Problem 8: long spans that occur verbatim in more than one document.

Method: compact windows. A text's tokens are its overlapping runs of ``gram`` characters; several hash functions order
them. For each function the Cartesian tree over the text's token hashes groups all subsequences of tokens that share a
minimum into windows (low, anchor, high), of which only those of at least ``span - gram + 1`` tokens matter. Texts that
share a span share the minimum of every part of it under every function, so the windows of all functions are interval-joined
within the text: a *cell* is a range of starting points at which a span has the same minima, and its signature is made of
all minima and their distances. Cells of equal signature are joined where their ranges leave room for a span, and each
candidate is verified by comparing the characters. All functions must agree, since the spans wanted are verbatim.

Hot signatures (more than ``hot`` texts) are not paired before they are verified: each of their cells emits the hashes of
its spans, and texts that share such a hash are a match by themselves. Of the shared spans only those are paired that do not
follow, in all their texts, the same character: the others link no further texts. Equal texts are one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm.text import mix
from quillon.session import stage

_BASE = 0x2545F4914F6CDD1D  # odd, so that its powers have inverses modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTOR = 0xD1342543DE82EF95
#: Starting points of a text that are handled at once, and those whose characters travel in one row.
CHUNK, SEGMENT = 1 << 20, 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` code points, from one running sum."""
    n = len(points)
    if n < gram:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1:], dtype=np.uint64)
    return mix((total[gram:] - total[:-gram]) * _powers(_INVERSE, n - gram + 1))


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, in time independent of the width."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def compact_windows(hashes: np.ndarray, least: int, row: np.ndarray, gram: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, low, high): the nodes of the Cartesian trees over ``hashes`` that span at least ``least`` tokens, from left
    to right, one tree for each text. ``row`` has the text of every character; a token is ``gram`` characters of one text.
    Ties go to the left.

    Such nodes are the distinct minima of a sliding window. All ancestors of a node span more than it does, so the nearest
    smaller token on either side, where its subtree ends, is itself among them: the trees are built over these nodes alone."""
    n = len(hashes)
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    lowest = sliding_minimum(packed, least)
    lowest = lowest[row[: len(lowest)] == row[least + gram - 2 :]]  # windows of one text
    if not len(lowest):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    lowest = lowest[np.concatenate([[True], lowest[1:] != lowest[:-1]])]
    anchor = (lowest & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = row[anchor]
    low, high = np.searchsorted(row, text), np.searchsorted(row, text, side="right") - gram
    values, places, texts, spine = lowest.tolist(), anchor.tolist(), text.tolist(), []
    for k, value in enumerate(values):
        if spine and texts[spine[-1]] != texts[k]:
            spine = []
        while spine and values[spine[-1]] > value:
            high[spine.pop()] = places[k] - 1
        if spine:
            low[k] = places[spine[-1]] + 1
        spine.append(k)
    return anchor, low, high


def cells(points: np.ndarray, row: np.ndarray, gram: int, span: int, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, anchor, first, last) of the cells of texts that follow each other, ``row`` having the text of each
    character: starting points first..last, at which a span has the same minima under all hash functions; the anchor is
    that of the first function."""
    least = span - gram + 1
    grams = gram_hashes(points, gram)
    held = []
    for k in range(hashes):
        h = grams * np.uint64(pow(_FACTOR, 2 * k + 1, 1 << 64))  # the upper half of the product orders the tokens
        anchor, low, _ = compact_windows(h, least, row, gram)
        held.append((np.maximum(low, anchor - least + 1), anchor, h))
    first = np.unique(np.concatenate([starts for starts, _, _ in held]))
    end = np.searchsorted(row, row[first], side="right") - span
    last = np.minimum(end, np.append(first[1:] - 1, len(points))) if len(first) else end
    signature = np.full(len(first), hashes, np.uint64)
    lead = None
    for starts, anchor, h in held:
        at = anchor[np.searchsorted(starts, first, side="right") - 1]
        lead = at if lead is None else lead
        signature = mix(mix(signature * np.uint64(31) + h[at]) + (at - lead).astype(np.uint64))
    return signature, lead, first, last


def keyed_texts(documents: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """(id, k1, k2, n_chars, text) of the texts with at least ``span`` characters; k1 and k2 are 128 bits of a hash."""
    text = F.col(text_col).cast("string")
    return documents.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), F.length(text).alias("n_chars"), text.alias("text")
    ).where(F.col("n_chars") >= span)


def text_cells(documents: DataFrame, id_col: str, text_col: str, gram: int, span: int, hashes: int, window_rows: int, chunk: int) -> DataFrame:
    """(id, k1, k2, n_chars, part, cells) of the texts with at least ``span`` characters. Short texts are handled together,
    long ones ``chunk`` starting points at a time, and a text's cells are spread over rows of ``window_rows``; its first
    row has part 0."""
    structs = pa.struct([("value", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
    names = ["id", "k1", "k2", "n_chars", "part", "cells"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        *fixed, found = zip(*rows)
        value, *places = (np.concatenate(c) for c in zip(*found))
        flat = pa.StructArray.from_arrays([pa.array(value.view(np.int64)), *[pa.array(c.astype(np.int32)) for c in places]], names=[f.name for f in structs])
        ends = np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(structs))
        return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(fixed, kinds)], lists], names=names)

    def cut(texts: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The cells of texts, which are chunks of one or several together."""
        points = [np.frombuffer(t[-1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
        sizes = np.array([len(p) for p in points])
        begins = np.cumsum(sizes) - sizes
        value, *places = cells(np.concatenate(points), np.repeat(np.arange(len(points)), sizes), gram, span, hashes)
        ends = np.searchsorted(places[1], np.append(begins, sizes.sum()))
        rows: list[tuple] = []
        held = 0
        for k, (i, k1, k2, n, part, begin, _) in enumerate(texts):
            shift = begin - begins[k]
            for a in range(ends[k], ends[k + 1], window_rows):
                b = min(a + window_rows, ends[k + 1])
                rows.append((i, k1, k2, n, part, (value[a:b], *[p[a:b] + shift for p in places])))
                held += b - a
                part += 1
            if held >= window_rows:
                yield packed(rows)
                rows, held = [], 0
        if rows:
            yield packed(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[tuple] = []
        load = 0
        for batch in batches:
            for i, k1, k2, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                for begin in range(0, n - span + 1, chunk):
                    texts.append((i, k1, k2, n, begin, begin, text[begin : begin + chunk + span - 1]))
                    load += len(texts[-1][-1])
                    if load >= chunk:
                        yield from cut(texts)
                        texts, load = [], 0
        if texts:
            yield from cut(texts)

    picked = keyed_texts(documents, id_col, text_col, span)
    return picked.mapInArrow(run, "id long, k1 long, k2 long, n_chars int, part int, cells array<struct<value:long,at:int,first:int,last:int>>")


def _contexts(span: int):
    """Cuts the characters that the spans of every cell cover. Cells that follow each other with equal characters, as in
    repetitive texts, are one row; ``extra`` is how far the last lies behind the first."""
    names = ["text_key", "value", "first", "extra", "before", "around", "lead"]
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            found = batch.column(3)
            value, at, first, last = (found.values.field(c).to_numpy() for c in ("value", "at", "first", "last"))
            offsets = found.offsets.to_numpy()
            for k, (key, base, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                order = offsets[k] + np.argsort(first[offsets[k] : offsets[k + 1]], kind="stable")
                open_ = None
                for v, a, b, e in zip(*(c[order].tolist() for c in (value, at, first, last))):
                    around = piece[b - base : e + span - base]
                    if open_ and open_[1] == v and b - open_[2] - open_[3] <= span and open_[4] == a - b and open_[5] == around:
                        open_[3], open_[6] = b - open_[2], None  # the same again, a little further on
                        continue
                    open_ = [key, v, b, 0, a - b, around, piece[b - base - 1] if b else None]
                    out.append(open_)
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return run


def _common(x: str, y: str) -> int:
    """Length of the common beginning."""
    if x == y:
        return len(x)
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _verify(span: int):
    """The stretch that two cells of equal signature share around their anchors, if it is as long as a span."""
    columns = ("a", "b", "first_a", "first_b", "extra_a", "extra_b", "before_a", "before_b", "around_a", "around_b")
    kinds = [pa.int64()] * 2 + [pa.int32()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ka, kb, fa, fb, ea, eb, ba, bb, xa, xb in zip(*(batch.column(n).to_pylist() for n in columns)):
                left = _common(xa[:ba][::-1], xb[:bb][::-1])
                right = _common(xa[ba:], xb[bb:])
                if left + right >= span:
                    out.append((ka, kb, fa + ba - left, fb + bb - left, fa + ba + right + ea, fb + bb + right + eb))
            found = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], names=["a", "b", "from_a", "from_b", "to_a", "to_b"])

    return run


def _runs(span: int):
    """Hashes of the spans of each cell, where they lie, and the character before each (null: none, or several)."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, first, extra, text, lead in zip(*(batch.column(n).to_pylist() for n in ("text_key", "first", "extra", "around", "lead"))):
                for k in range(len(text) - span + 1):
                    h = xxhash.xxh3_128_digest(text[k : k + span])
                    out.append((key, first + k, first + k + span + extra, h, lead if not k else None if extra else text[k - 1]))
            for k in range(0, len(out), 50_000):
                columns = list(zip(*out[k : k + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["text_key", "start", "end", "run", "lead"])

    return run


def shared_spans(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = 300,
    gram: int = 64,
    hashes: int = 3,
    hot: int = 64,
    window_rows: int = 20_000,
    small: int = 1_000_000,
    chunk: int = CHUNK,
    segment: int = SEGMENT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members ``(id, text_key, n_chars)``, links ``(a, b)`` between different texts that share a span, and the shared
    stretches ``(text_key, start, end)``; a text_key is the smallest id of its text.

    Texts shorter than ``span`` characters and nulls belong to nothing; equal texts share a text_key. Very long and
    repetitive texts are handled in time proportional to their length, a chunk at a time, and travel in segments. An
    empty table gives empty results.
    """
    held = stage(text_cells(documents, id_col, text_col, gram, span, hashes, window_rows, chunk), "p8-cells")
    texts = held.where("part = 0").select("id", "k1", "k2", "n_chars")
    reps = stage(texts.groupBy("k1", "k2").agg(F.min("id").alias("text_key")), "p8-texts")
    members = texts.join(reps, ["k1", "k2"]).select("id", "text_key", "n_chars")
    found = held.select("k1", "k2", F.inline("cells"))
    values = found.groupBy("value").agg(*[f(c).alias(f"{n}_{c}") for c in ("k1", "k2") for n, f in (("low", F.min), ("high", F.max))])
    values = stage(values.where("low_k1 <> high_k1 or low_k2 <> high_k2").select("value"), "p8-values")
    if values.count() <= small:
        values = F.broadcast(values)
    live = found.join(values, "value", "left_semi").distinct().withColumn("seg", F.floor(F.col("first") / segment).cast("int"))
    live = live.groupBy("k1", "k2", "seg").agg(F.collect_list(F.struct("value", "at", "first", "last")).alias("cells"))  # at most a segment's
    live = stage(live, "p8-live")
    # one document per needed text, in segments that hold every span that starts in them and the character before
    needed = stage(live.select("k1", "k2").distinct().join(reps, ["k1", "k2"]).select(F.col("text_key").alias("id")), "p8-needed")
    if needed.count() <= small:
        needed = F.broadcast(needed)
    pieces = keyed_texts(documents, id_col, text_col, span).join(needed, "id", "left_semi")
    pieces = pieces.select("id", "k1", "k2", "text", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 1) / segment).cast("int"))).alias("seg"))
    base = F.greatest(F.col("seg") * segment - 1, F.lit(0))
    pieces = pieces.select("k1", "k2", "seg", F.col("id").alias("text_key"), base.alias("base"), F.substring("text", base + 1, F.lit(segment + 2 * span)).alias("piece"))
    around = pieces.join(live, ["k1", "k2", "seg"]).select("text_key", "base", "piece", "cells")
    around = around.mapInArrow(_contexts(span), "text_key long, value long, first int, extra int, before int, around string, lead string")
    around = stage(around, "p8-contexts")
    crowd = stage(around.groupBy("value").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("value"), "p8-hot")
    if crowd.count() <= small:
        crowd = F.broadcast(crowd)
    cold = around.join(crowd, "value", "left_anti").withColumn("after", F.length("around") - span - F.col("before"))
    warm = around.join(crowd, "value", "left_semi")

    columns = ("first", "extra", "before", "after", "around")
    side = lambda s: cold.select("value", F.col("text_key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    # the ranges of starting points, seen from the anchors, must overlap
    room = F.least("before_a", "before_b") + F.least("after_a", "after_b") >= 0
    candidates = side("a").join(side("b"), "value").where((F.col("a") < F.col("b")) & room)
    verified = candidates.drop("value", "after_a", "after_b").mapInArrow(_verify(span), "a long, b long, from_a int, from_b int, to_a int, to_b int")
    verified = stage(verified, "p8-verified")

    runs = warm.select("text_key", "first", "extra", "around", "lead").mapInArrow(_runs(span), "text_key long, start int, end int, run binary, lead string")
    runs = runs.groupBy("text_key", "run").agg(
        F.min("lead").alias("low"), F.max("lead").alias("high"), F.bool_and(F.col("lead").isNotNull()).alias("known"), F.collect_set(F.struct("start", "end")).alias("stretches")
    )
    runs = stage(runs, "p8-runs")
    common = runs.groupBy("run").agg(
        F.min("text_key").alias("x"), F.max("text_key").alias("y"), (F.bool_and("known") & (F.min("low") == F.max("high"))).alias("follows")
    )
    shared = runs.join(common.where("x <> y").select("run", "follows"), "run")
    opening = shared.where("not coalesce(follows, false)").select("run", "text_key")
    crowded = opening.withColumnRenamed("text_key", "a").join(opening.withColumnRenamed("text_key", "b"), "run").where("a < b").select("a", "b")
    links = verified.select("a", "b").unionByName(crowded).distinct()
    stretches = (
        verified.select(F.explode(F.array(*[F.struct(F.col(x).alias("text_key"), F.col(f"from_{x}").alias("start"), F.col(f"to_{x}").alias("end")) for x in "ab"])).alias("s"))
        .select("s.*")
        .unionByName(shared.select("text_key", F.inline("stretches")))
        .distinct()
    )
    return members, links, stretches


def span_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All (doc_a, doc_b), doc_a < doc_b, that share a span: equal texts and linked ones."""
    copies = members.select("text_key", F.col("id").alias("x")).join(members.select("text_key", F.col("id").alias("y")), "text_key").where("x < y")
    linked = links.join(members.select(F.col("text_key").alias("a"), F.col("id").alias("x")), "a").join(members.select(F.col("text_key").alias("b"), F.col("id").alias("y")), "b")
    both = copies.select("x", "y").unionByName(linked.select("x", "y"))
    return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def document_stretches(members: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc_id, start, end): the stretches of each document that occur in another one too, overlapping and touching ones
    merged, end exclusive; a document with an equal twin is one stretch."""
    order = W.partitionBy("text_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = stretches.select("text_key", "start", "end", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int").alias("opens"))
    merged = opens.withColumn("nth", F.sum("opens").over(order)).groupBy("text_key", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    twins = members.groupBy("text_key").agg(F.count("*").alias("k"))
    known = members.join(twins, "text_key")
    whole = known.where("k > 1").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.col("n_chars").cast("long").alias("end"))
    parts = known.where("k = 1").join(merged, "text_key").select(F.col("id").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    return whole.unionByName(parts)


def shared_share(members: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share): how much of each document of ``span`` characters or more occurs in
    another document too. Overlapping stretches count once; a document with an equal twin is shared as a whole."""
    order = W.partitionBy("text_key").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    covered = (
        stretches.select("text_key", "end", F.greatest("start", F.coalesce(reach, F.lit(0))).alias("start"))
        .where("end > start")
        .groupBy("text_key")
        .agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    )
    twins = members.groupBy("text_key").agg(F.count("*").alias("k"))
    shared = F.when(F.col("k") > 1, F.col("n_chars").cast("long")).otherwise(F.coalesce("covered", F.lit(0)))
    return (
        members.join(twins, "text_key")
        .join(covered, "text_key", "left")
        .select(F.col("id").alias("doc_id"), "n_chars", shared.alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("share"))
    )
