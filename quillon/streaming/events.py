"""Structured Streaming over event files. An extension: nothing in the evaluated workload is a stream.

Streams run to completion (``availableNow``) into a table that every micro-batch replaces, so that results can be
compared with a batch query; a service would use the same frames with an append sink and its own trigger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.numbers import rounded
from quillon.session import new_folder

_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event files of a data folder as a stream, whether ``events.parquet`` is a file or a folder."""
    reader = spark.readStream.schema(_SCHEMA).option("maxFilesPerTrigger", 4).option("recursiveFileLookup", True)
    probe = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = probe.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(probe).isDirectory():
        stream = reader.parquet(f"{sf_dir}/events.parquet")
    else:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_complete(result: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run an aggregating stream over all available files; the state of its last micro-batch."""
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-state")
    query = (
        result.writeStream.outputMode("complete")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def windowed_counts(stream: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events and values per window and type; events later than the watermark are dropped once their window closed."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), rounded(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user: runs of events with pauses below the gap."""
    s = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(s.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "n")
