"""Problem 6: filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Method: hierarchical residual packing. Items are spread over slots by a hash; each slot packs its items best-fit with
the largest first and emits bins that are nearly full. The underfull bins go on as items of their joint size: neighbouring
slots are merged so that each holds about ``slot_items`` items again, and packed once more, until one slot is left or a
round hardly lessens the bins, which then cannot be combined. No bin is closed before that, and no slot outgrows a task.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stage

#: The pre-tokenisation pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the vocabulary files of public tokenizers lie; byte_bpe_50k counts the tokens unless another is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_ENCODERS: dict[str, object] = {}
#: Runs of blanks on which the tokenizer's own pattern engine may run out of stack.
_LONG_RUN = re.compile(r"\s{10001}")


def encoder(path: str = VOCABULARY):
    """The byte-level BPE tokenizer of a rank file; kept for the life of the worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("quillon", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def count_tokens(enc, text: str) -> int:
    """Tokens of a text. Where it has a run of over 10,000 blanks, another engine cuts it by the same pattern, and the
    tokenizer merges each piece: the same tokens without its pattern engine, which fails on such runs."""
    if _LONG_RUN.search(text):
        import regex

        return sum(len(enc._encode_single_piece(m.group())) for m in regex.finditer(PATTERN, text))
    return len(enc.encode_ordinary(text))


def token_counts(documents: DataFrame, id_col: str, text_col: str, vocabulary: str) -> DataFrame:
    """(id, tokens): the number of tokens of every text, 0 for a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            counts = [count_tokens(enc, x) if x else 0 for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "tokens"])

    picked = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "id long, tokens long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, best fit in the given order. A bit per residual finds the tightest bin at once."""
    holders: dict[int, list[int]] = {}
    mask = 0
    out = [0] * len(sizes)
    bins = 0
    for i, size in enumerate(sizes):
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = holders[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room, b = capacity, bins
            bins += 1
        out[i] = b
        room -= size
        if room:
            if mask >> room & 1:
                holders[room].append(b)
            else:
                holders[room] = [b]
                mask |= 1 << room
    return out


def _pack(level: int, nearly_full: float):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        spec, slot = key
        capacity = int(items["capacity"].iloc[0])
        items = items.sort_values(["size", "name"], ascending=[False, True], kind="stable")
        sizes = items["size"].to_numpy()
        place = np.array(best_fit(sizes.tolist(), capacity), dtype=np.int64)
        filled = np.bincount(place, weights=sizes).astype(np.int64)
        full = (filled >= nearly_full * capacity) | bool(items["last"].iloc[0])
        order = np.argsort(place, kind="stable")
        members = items["members"].to_numpy()[order]
        ends = np.cumsum(np.bincount(place))
        starts = ends - np.bincount(place)
        joined = [np.concatenate(members[a:b]) if b > a + 1 else members[a] for a, b in zip(starts, ends)]
        return pd.DataFrame(
            {
                "spec_id": spec,
                "slot": slot,
                "capacity": capacity,
                "size": filled,
                "name": [f"{spec}-{level}-{slot}-{k}" for k in range(len(filled))],
                "members": joined,
                "full": full,
            }
        )

    return run


def pack_texts(
    documents: DataFrame,
    spec: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    nearly_full: float = 0.98,
    slot_items: int = 20_000,
    stalled: float = 0.95,
) -> DataFrame:
    """(spec_id, container_id, doc_id, part, start_token, n_tokens) for every capacity of ``spec(spec_id, capacity_tokens)``.

    A text that fits is one part. A longer one is cut every ``capacity`` tokens; its full parts are containers of their
    own, its rest is packed like any other item. Rounds end when one slot is left or a round leaves more than the share
    ``stalled`` of its bins; these then stay as they are. Null and empty texts have no tokens: they appear with a null container
    and part. Specs with a null or non-positive capacity are left out; an empty table gives an empty result.
    """
    counted = stage(token_counts(documents, id_col, text_col, vocabulary), "p6-tokens")
    spec = spec.where("capacity_tokens > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("int").alias("capacity"))
    sized = counted.where("tokens > 0").crossJoin(F.broadcast(spec))  # a handful of specs, not a join of rows with rows
    whole = F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("long")  # full parts before the last part
    last = F.col("tokens") - F.col("whole") * F.col("capacity")
    sized = sized.withColumn("whole", whole).withColumn("last", last)
    full_parts = sized.where("whole > 0").select(
        "spec_id", "capacity", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part"), F.col("capacity").cast("long").alias("n_tokens")
    )
    n = counted.where("tokens > 0").count()
    # (slots, items) of each spec that is still being packed; specs are a handful
    open_ = {r.spec_id: (max(1, -(-n // slot_items)), n) for r in spec.collect()}
    items = sized.select(
        "spec_id",
        F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // slot_items)))).cast("long").alias("slot"),
        "capacity",
        F.col("last").alias("size"),
        F.col("id").cast("string").alias("name"),
        F.array("id", "whole", "last").alias("members"),
        F.lit(n <= slot_items).alias("last"),
    )
    schema = "spec_id int, slot long, capacity int, size long, name string, members array<long>, full boolean"
    done: list[DataFrame] = []
    level = 0
    while True:
        packed = items.groupBy("spec_id", "slot").applyInPandas(_pack(level, nearly_full), schema)
        packed = stage(packed, f"p6-level{level}")
        done.append(packed.where("full"))
        left = {r.spec_id: r["count"] for r in packed.where("not full").groupBy("spec_id").count().collect()}
        if not left:
            break
        merge = F.lit(None)
        final = []
        for s, k in left.items():
            slots, before = open_[s]
            merged = max(1, min(-(-k // slot_items), slots // 2))
            open_[s] = merged, k
            merge = F.when(F.col("spec_id") == s, F.floor(F.col("slot") * merged / slots)).otherwise(merge)
            if merged == 1 or k > stalled * before:  # one slot at the end, or several that combine no further
                final.append(s)
        items = packed.where("not full").drop("full").withColumns({"slot": merge.cast("long"), "last": F.col("spec_id").isin(final)})
        level += 1
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    triple = F.transform(F.sequence(F.lit(1), F.size("members"), F.lit(3)), lambda k: F.slice("members", k, 3))
    parts = bins.select("spec_id", "capacity", F.col("name").alias("container_id"), F.explode(triple).alias("m")).select(
        "spec_id", "container_id", F.col("m")[0].alias("doc_id"), F.col("m")[1].alias("part"), (F.col("m")[1] * F.col("capacity")).alias("start_token"), F.col("m")[2].alias("n_tokens")
    )
    cut = full_parts.select(
        "spec_id",
        F.concat_ws("-", "spec_id", F.lit("cut"), "id", "part").alias("container_id"),
        F.col("id").alias("doc_id"),
        "part",
        (F.col("part") * F.col("capacity")).alias("start_token"),
        "n_tokens",
    )
    nothing = F.lit(None)
    void = counted.where("tokens = 0").crossJoin(F.broadcast(spec)).select(
        "spec_id", nothing.cast("string").alias("container_id"), F.col("id").alias("doc_id"), nothing.cast("long").alias("part"), nothing.cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens")
    )
    return parts.unionByName(cut).unionByName(void)


def fill_report(packed: DataFrame, spec: DataFrame) -> DataFrame:
    """Per capacity: texts, containers, tokens, the least containers these tokens need, and the share of space used."""
    per_bin = packed.where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("parts"))
    return (
        per_bin.groupBy("spec_id")
        .agg(F.count("*").alias("n_containers"), F.sum("parts").alias("n_parts"), F.sum("held").alias("n_tokens"), F.max("held").alias("most"))
        .join(F.broadcast(spec.select("spec_id", "capacity_tokens")), "spec_id")
        .select(
            "spec_id",
            "n_containers",
            "n_parts",
            "n_tokens",
            "most",
            F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"),
            F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6).alias("used"),
        )
    )
