"""Problem 3: records hidden by formatting differences, collapsed into one each with the number of copies.

Method: every line gets a canonical key. Keys are counted with partial counts; those with at least ``hot`` lines are hot
and known exactly. Hot keys are aggregated in two levels over salted keys, all others in one shuffle. The smallest
identifier of a key represents it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import stage

_ALNUM = re.compile(r"[^\W_]+")


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def _value(x: object) -> object:
    """A JSON value in a form where values that are equal as numbers, strings or structures are equal."""
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, float):
        return int(x) if x.is_integer() and abs(x) < 1 << 53 else x
    if isinstance(x, list):
        return [_value(v) for v in x]
    if isinstance(x, dict):
        return {k: _value(v) for k, v in x.items()}
    return x


def canonical_key(line: str | None, free_text: str = "caption") -> str | None:
    """A 128-bit key of the record in a JSON line, null if the line is no JSON object.

    Only letters and digits of ``free_text`` count, in order and regardless of case; all other fields count by value;
    an absent field is null."""
    if line is None:
        return None
    try:
        record = json.loads(line, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None
    if not isinstance(record, dict):
        return None
    caption = record.pop(free_text, None)
    fields = {k: _value(v) for k, v in record.items() if v is not None}
    letters = "".join(_ALNUM.findall(caption.lower())) if isinstance(caption, str) else ["other", _value(caption)]
    if caption is None:
        letters = None
    return xxhash.xxh3_128_hexdigest(json.dumps([letters, fields], sort_keys=True))


def keyed_lines(lines: DataFrame, id_col: str, text_col: str, free_text: str) -> DataFrame:
    """(id, key) of all lines that hold a JSON object."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([canonical_key(x, free_text) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], names=["id", "key"]).filter(keys.is_valid())

    picked = lines.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("line"))
    return picked.mapInArrow(run, "id long, key string")


def collapse_lines(
    lines: DataFrame,
    id_col: str = "line_id",
    text_col: str = "line_text",
    free_text: str = "caption",
    hot_share: float = 1e-4,
    hot_least: int = 1000,
    salts: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """Keyed lines ``(id, key)`` and records ``(key, keep_id, n_copies, hot)``.

    A key is hot from max(``hot_least``, ``hot_share`` of all lines) lines on, so there are at most 1/hot_share hot keys
    and their list can be broadcast. Lines that are null, broken or no object belong to no record; a null caption differs
    from one without letters; lines with equal identifiers count each. An empty table gives empty results.
    """
    keyed = stage(keyed_lines(lines, id_col, text_col, free_text), "p3-keys")
    total = keyed.count()
    least = max(hot_least, int(hot_share * total))
    hot = keyed.groupBy("key").count().where(F.col("count") >= least).select("key")
    marked = keyed.join(F.broadcast(stage(hot, "p3-hot").withColumn("hot", F.lit(True))), "key", "left")
    cold = marked.where("hot is null").groupBy("key").agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))
    warm = (
        marked.where("hot")
        .groupBy("key", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("n_copies"))
        .groupBy("key")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies"))
    )
    records = cold.withColumn("hot", F.lit(False)).unionByName(warm.withColumn("hot", F.lit(True)))
    return keyed, stage(records, "p3-records")


def copies(keyed: DataFrame, records: DataFrame) -> DataFrame:
    """(keep_id, copy_id), one row for each line beyond the smallest of its record. Hot keys meet their lines through a
    broadcast (their number is bounded), all others through a shuffle."""
    several = records.where("n_copies > 1")
    hot = several.where("hot").select("key", "keep_id")
    cold = several.where("not hot").select("key", "keep_id")
    warm = keyed.join(F.broadcast(hot), "key")
    rest = keyed.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key")
    both = warm.select("keep_id", "id").unionByName(rest.select("keep_id", "id"))
    return both.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))
