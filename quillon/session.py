"""Session helpers: table access and written stages.

A *stage* is an intermediate table written as Parquet below the shared folder that the cluster names in
``spark.checkpoint.dir``. It cuts the lineage, survives the loss of executors, and is read back with column pruning,
so that an expensive scan (tokenising, signatures) runs once however often its columns are used.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder for stages: ``spark.checkpoint.dir`` if set, else, in local mode only, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; removed when the process ends."""
    root = f"{work_folder(spark)}/quillon-{os.getpid()}"
    if not _FOLDERS:
        atexit.register(remove_stages)
    _FOLDERS[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def kept_folder(spark: SparkSession, name: str, key: str) -> str:
    """The folder of ``key`` below the shared one, created if missing; the same in every process and never removed."""
    folder = f"{work_folder(spark)}/quillon-kept/{name}-{hashlib.md5(key.encode()).hexdigest()[:16]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stages() -> None:
    """Delete all stages this process has written. Results that still read them become unusable."""
    for root, spark in list(_FOLDERS.items()):
        try:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
    _FOLDERS.clear()
