"""Readers for the formats evaluation data comes in: keyed JSON, JSONL, judgment sheets, signal files, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The canonical Pair record as JSON.
PAIR_JSON = "dataset string, split string, sample_id string, caption_id string, series array<double>, caption string, class_label string"


def json_records(lines: DataFrame, text_col: str, schema: str) -> DataFrame:
    """The lines with ``rec``, their record under a fixed schema, and ``broken``, true where the line is no JSON object
    of that schema. Missing keys are null."""
    parsed = F.from_json(text_col, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    lines = lines.withColumn("rec", parsed)
    return lines.withColumn("broken", F.col("rec._broken").isNotNull() | F.col("rec").isNull())


def keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) of files that hold one JSON object each, keyed by id."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{value_schema}>>")).alias("key", "value"))


def annotation_texts(raw: Column) -> Column:
    """The texts of a polymorphic JSON field: a list of strings or a list of lists of strings."""
    nested = F.from_json(raw, "array<array<string>>")
    return F.when(raw.rlike(r"^\s*\[\s*\["), F.flatten(nested)).otherwise(F.from_json(raw, "array<string>"))


def judgment_sheet(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV sheet with a banner line beginning with ``#`` before the header; a byte-order mark is dropped."""
    df = spark.read.schema(schema).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path, header=True, comment="#", enforceSchema=True)
    return df


def decoded_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding, text) of text files in UTF-8, else GBK, else Windows-1252, and which it was."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))

    @F.pandas_udf("string")
    def other(content: pd.Series) -> pd.Series:
        def one(c: bytes) -> str:
            try:
                return "gbk:" + c.decode("gbk")
            except UnicodeDecodeError:
                return "cp1252:" + c.decode("cp1252", "replace")

        return content.map(one)

    text = F.when(valid, F.concat(F.lit("utf-8:"), F.regexp_replace(F.col("content").cast("string"), "^﻿", ""))).otherwise(other("content"))
    return files.select("file", text.alias("t")).select("file", F.substring_index("t", ":", 1).alias("encoding"), F.expr("substring(t, instr(t, ':') + 1)").alias("text"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line; comments after ``#`` and blank lines are dropped."""
    ids = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("id"))
    return ids.where("id <> ''")


def signal_files(spark: SparkSession, folder: str, name: str = r"^\d{7}\.csv$") -> DataFrame:
    """(file, series) of all files below a folder whose names fit the pattern, one value a line or by commas."""
    files = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"), "value").where(F.col("name").rlike(name))
    return files.select("file", F.filter(F.transform(F.split(F.trim("value"), r"[,\s]+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull()).alias("series"))


def metadata_with_signals(metadata: DataFrame, signals: DataFrame, path_col: str) -> tuple[DataFrame, DataFrame]:
    """Metadata rows joined to the signal file they name, and the rows whose file is missing."""
    stem = F.regexp_extract(F.replace(F.col(path_col), F.lit("\\"), F.lit("/")), r"([^/]+)$", 1)
    files = signals.select(F.regexp_extract("file", r"([^/]+)$", 1).alias("stem"), "series")
    named = metadata.withColumn("stem", stem)
    return named.join(files, "stem"), named.join(files, "stem", "left_anti")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, content, error) of zip files; a bad member gives its error and no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.namelist():
                            try:
                                rows.append((archive, m, z.read(m), None))
                            except Exception as e:  # noqa: BLE001  any damage is reported, not raised
                                rows.append((archive, m, None, type(e).__name__))
                except zipfile.BadZipFile as e:
                    rows.append((archive, None, None, type(e).__name__))
                yield pd.DataFrame(rows, columns=["archive", "member", "content", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, member string, content binary, error string")


def audit_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, n, finite): whether each ``.npy`` file loads as numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    x = np.load(io.BytesIO(content), allow_pickle=False)
                    rows.append((file, "ok", x.size, bool(np.isfinite(x).all())))
                except Exception as e:  # noqa: BLE001
                    rows.append((file, type(e).__name__, None, None))
            out = pd.DataFrame(rows, columns=["file", "status", "n", "finite"])
            yield out.astype({"n": "Int64", "finite": "boolean"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, status string, n long, finite boolean")
