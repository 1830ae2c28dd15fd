"""Sinks: partitioned tables, JSON lines, judgment sheets, resumable appends, caches."""

from __future__ import annotations

import io
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import stage


def write_pairs(pairs: DataFrame, path: str) -> None:
    """The canonical table, partitioned by dataset and split."""
    pairs.write.partitionBy("dataset", "split").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_sheet(df: DataFrame, path: str, verdicts: list[str], banner: str | None = None, mark: bool = False) -> None:
    """A CSV sheet in one file with empty verdict columns, an optional banner line and byte-order mark. Sheets are for
    people, so one task writes them."""
    columns = [*df.columns, *verdicts]
    cells = df.select(*[F.col(c).cast("string") for c in df.columns], *[F.lit("").alias(v) for v in verdicts])
    quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])
    spark = df.sparkSession
    head = [x for x in (f"# {banner}" if banner else None, ",".join(columns)) if x]
    if mark:
        head[0] = "﻿" + head[0]
    top = spark.createDataFrame([(k, h) for k, h in enumerate(head)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value")
    top.unionAll(cells.select(quoted.alias("value"))).coalesce(1).write.text(path)


def resume(jobs: DataFrame, spark: SparkSession, path: str, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> int:
    """Append the results of the jobs whose keys the table at ``path`` does not hold yet; the number of jobs run."""
    try:
        done = spark.read.parquet(path).select(*keys)
        left = jobs.join(done, keys, "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        left = jobs
    left = stage(left, "jobs-left")  # counted and run, joined once
    n = left.count()
    if n:
        run(left).write.mode("append").parquet(path)
    return n


def hash_encoder(width: int = 16) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a text encoder: unit vectors from hashes."""

    def encode(texts: list[str]) -> np.ndarray:
        raw = np.array([[xxhash.xxh32_intdigest(t, seed=k) for k in range(width)] for t in texts], dtype=np.float64)
        v = raw / 2**31 - 1
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    return encode


def content_key(text: str = "text"):
    return F.substring(F.sha2(F.col(text), 256), 1, 32)


def encode_missing(texts: DataFrame, spark: SparkSession, cache: str, encode: Callable[[list[str]], np.ndarray], retries: int = 5, wait: float = 1.0) -> int:
    """Encode the distinct texts the cache at ``cache`` does not hold, and append them; the number encoded. A batch that
    fails is tried again up to ``retries`` times, after ``wait`` seconds and then twice as long each time; vectors of
    unequal width or not one per text are an error; stale rows cannot occur, since keys are content hashes."""
    keyed = texts.where("text is not null").select("text").distinct().select(content_key().alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(1).to_pylist()
            for attempt in range(retries):
                try:
                    vectors = encode(values)
                    break
                except Exception:
                    if attempt == retries - 1:
                        raise
                    time.sleep(wait * 2**attempt)
            if vectors.ndim != 2 or len(vectors) != len(values):
                raise ValueError(f"{len(values)} texts gave vectors of shape {vectors.shape}")
            flat = pa.array(vectors.astype(np.float32).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, vectors.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "vec"])

    return resume(keyed, spark, cache, ["key"], lambda left: left.select("key", "text").mapInArrow(run, "key string, vec array<float>"))


def write_files(files: DataFrame, folder: str) -> None:
    """Each row of ``files(name, content binary)`` as a file of its own below the folder, on any file system that Arrow
    knows; names may have folders. A file of that name is replaced, so a task that runs again does no harm."""

    def write(rows: Iterator) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        known = set()
        for r in rows:
            path = f"{root}/{r.name}"
            parent = path.rsplit("/", 1)[0]
            if parent not in known:
                system.create_dir(parent, recursive=True)
                known.add(parent)
            with system.open_output_stream(path) as out:
                out.write(bytes(r.content))

    files.select("name", "content").foreachPartition(write)


def npy_content(x: str) -> Column:
    """Series as the contents of ``.npy`` files."""

    def one(values) -> bytes | None:
        if values is None:
            return None
        out = io.BytesIO()
        np.save(out, np.asarray(values, dtype=np.float64))
        return out.getvalue()

    @F.pandas_udf("binary")
    def contents(column: pd.Series) -> pd.Series:
        return column.map(one)

    return contents(x)


def repair_npy(audit: DataFrame, signals: DataFrame, folder: str) -> None:
    """Files of ``audit(file, status)`` that do not load, written anew from the signal file of the same name."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+)\.\w+$", 1)
    torn = stage(audit.where("status <> 'ok'").select(stem("file").alias("stem")), "torn")
    found = torn.join(signals.select(stem("file").alias("stem"), "series"), "stem")
    write_files(found.select(F.concat("stem", F.lit(".npy")).alias("name"), npy_content("series").alias("content")), folder)
