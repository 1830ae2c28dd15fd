"""Problem 5: a reproducible sample that stays stable as data grows.

Method: a ledger of selected keys in a folder that outlives the process. It is read first and only appended to: all
earlier keys are kept by a join, and each growth step fills the grown quota of its stratum from the keys not yet in the
ledger, lowest hash priority first. Without a ledger, only steps at times that the table has reached can be rebuilt alike.

All steps are decided at once. The unseen keys are counted per stratum, step of arrival and bucket of priorities, and each
stratum's growth is played through on these counts, whose number is bounded. What comes out is one cut-off per step: the
bucket below which every key known by then is selected. Only keys in a cut-off's own bucket, a 65,536th of a stratum,
are ranked, so no stratum is ever sorted as a whole and the number of shuffles does not depend on the number of steps.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.splits import BLANKS, caption_sample, sample_name
from quillon.session import new_folder, stage

_LEDGER = "stratum string, key string, priority string, step int"
_DIGITS = 4  # hex digits of a priority that make its bucket


def sample_keys(records: DataFrame, salt: str = "s1") -> DataFrame:
    """(stratum, key, priority, first_loaded, keep_no, n_rows): one row per distinct caption of a sample.

    The key joins the sample's name and the caption id, both regardless of case, slashes and outer blanks, so repeated
    rows are one key; the sample's name is that of sample_id or, if null, the one before the last ``#`` of caption_id.
    Rows without caption_id are left out. The stratum of a key is the dataset of its first loaded row (of several the
    smallest; null times last), so rows that come later do not move it.
    """
    name = F.coalesce(sample_name(F.col("sample_id")), caption_sample(F.col("caption_id")), F.lit(""))
    keyed = records.where("caption_id is not null").select(
        F.concat_ws("|", name, sample_name(F.col("caption_id"))).alias("key"),
        F.coalesce(F.btrim(F.col("dataset"), F.lit(BLANKS)), F.lit("")).alias("dataset"),
        "loaded_at",
        "pair_no",
    )
    return keyed.groupBy("key").agg(
        F.min_by("dataset", F.struct(F.col("loaded_at").isNull(), "loaded_at", "dataset")).alias("stratum"),
        F.min("loaded_at").alias("first_loaded"),
        F.min("pair_no").alias("keep_no"),
        F.count("*").alias("n_rows"),
    ).withColumn("priority", F.md5(F.concat_ws("|", F.lit(salt), "key")))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], _LEDGER)


def extend_ledger(ledger: DataFrame, keys: DataFrame, per_mille: int, step: int) -> DataFrame:
    """The ledger after ``keys(stratum, key, priority)`` have become known: every earlier entry and the new ones."""
    added = new_entries(ledger, keys.withColumn("arrival", F.lit(0)), per_mille, 1)
    return ledger.unionByName(added.withColumn("step", F.lit(step)))


def _cut_offs(per_mille: int, steps: int):
    """Plays one stratum's growth through on counts by (arrival, bucket); gives (step, bucket, n): at that step all known
    unseen keys of lower buckets are selected, and the n lowest of this bucket."""

    def run(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        held = int(counts.loc[counts["bucket"] < 0, "n"].sum())
        fresh = counts[counts["bucket"] >= 0]
        arriving = np.zeros((steps, 16**_DIGITS), dtype=np.int64)
        np.add.at(arriving, (fresh["arrival"].to_numpy(), fresh["bucket"].to_numpy()), fresh["n"].to_numpy())
        known, waiting, out = held, np.zeros(16**_DIGITS, dtype=np.int64), []
        for step in range(steps):
            waiting += arriving[step]
            known += int(arriving[step].sum())
            room = min((known * per_mille + 999) // 1000 - held, int(waiting.sum()))
            if room <= 0:
                continue
            reached = np.cumsum(waiting)
            cut = int(np.searchsorted(reached, room))
            left = room - int(reached[cut] - waiting[cut])
            waiting[:cut] = 0
            waiting[cut] -= left
            held += room
            out.append((key[0], step, cut, left))
        return pd.DataFrame(out, columns=["stratum", "step", "bucket", "n"])

    return run


def _picked(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    """The selected keys of one bucket that a cut-off falls into, with the step that selects each."""
    keys = keys.sort_values(["priority", "key"], kind="stable").reset_index(drop=True)
    arrival = keys["arrival"].to_numpy()
    step_of = np.full(len(keys), -1)
    for cut in sorted(keys["cuts"].iloc[0], key=lambda c: c["step"]):
        if cut["bucket"] < key[1]:
            continue
        open_ = np.flatnonzero((arrival <= cut["step"]) & (step_of < 0))
        step_of[open_ if cut["bucket"] > key[1] else open_[: cut["n"]]] = cut["step"]
    keys["step"] = step_of
    return keys.loc[step_of >= 0, ["stratum", "key", "priority", "step"]]


def new_entries(ledger: DataFrame, keys: DataFrame, per_mille: int, steps: int) -> DataFrame:
    """What ``keys(stratum, key, priority, arrival)`` add to the ledger in ``steps`` growth steps, each key being known
    from step ``arrival`` on: of the unseen keys those of lowest priority until each stratum holds per_mille in a thousand
    of its known keys, rounded up.

    A quota below what the ledger holds selects nothing and drops nothing. Keys of the ledger count as known, in the
    ledger's stratum, whether or not they are among the keys. Priorities are hex strings."""
    fresh = keys.join(ledger.select("key"), "key", "left_anti").withColumn("bucket", F.conv(F.substring("priority", 1, _DIGITS), 16, 10).cast("int"))
    counts = fresh.groupBy("stratum", "arrival", "bucket").agg(F.count("*").alias("n")).unionByName(
        ledger.groupBy("stratum").agg(F.count("*").alias("n")).select("stratum", F.lit(0).alias("arrival"), F.lit(-1).alias("bucket"), "n")
    )
    cuts = counts.groupBy("stratum").applyInPandas(_cut_offs(per_mille, steps), "stratum string, step int, bucket int, n long")
    cuts = stage(cuts.groupBy("stratum").agg(F.collect_list(F.struct("step", "bucket", "n")).alias("cuts")), "p5-cuts")
    side = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts  # a row per stratum
    due = fresh.join(side, "stratum")
    clear = F.filter("cuts", lambda c: (c["step"] >= F.col("arrival")) & (c["bucket"] > F.col("bucket")))
    split = F.exists("cuts", lambda c: (c["step"] >= F.col("arrival")) & (c["bucket"] == F.col("bucket")))
    ranked = due.where(split).groupBy("stratum", "bucket").applyInPandas(_picked, "stratum string, key string, priority string, step int")
    whole = due.where(~split).select("stratum", "key", "priority", F.array_min(F.transform(clear, lambda c: c["step"])).alias("step")).where("step is not null")
    return whole.unionByName(ranked)


def closed_cutoffs(records: DataFrame, cutoffs: list[str], months: int = 6) -> list[str]:
    """The cut-offs that the table has reached, carried on every ``months`` months up to its latest ``loaded_at``.

    Rows loaded later than all of the table cannot fall before any of them."""
    latest = records.agg(F.max("loaded_at").cast("string")).first()[0]
    if latest is None:
        return []
    out, last = list(cutoffs), datetime.fromisoformat(cutoffs[-1])
    while out[-1] <= latest:
        last = last.replace(year=last.year + (last.month - 1 + months) // 12, month=(last.month - 1 + months) % 12 + 1)
        out.append(str(last))
    return [c for c in out if c <= latest]


def grow_sample(
    records: DataFrame, cutoffs: list[str], per_mille: int = 100, salt: str = "s1", folder: str | None = None, open_step: bool = True
) -> DataFrame:
    """The ledger (stratum, key, priority, step, keep_no, n_rows) after rows arrived in order of ``loaded_at``.

    Step k sees the keys first loaded before ``cutoffs[k]``; a last step, unless ``open_step`` is false, sees all, null
    times included. ``folder`` holds the ledger: what is in it is read first and kept, and what the steps add is appended,
    so equal input adds nothing. Without a folder the ledger starts empty; then a step that sees rows up to a time the
    table has not reached, as the last one does, is filled anew from a grown table and may drop keys. Ledger keys that the
    table no longer has are kept in the folder but give no row. An empty table gives an empty ledger; rows of a key that
    come later never change whether it is selected.
    """
    spark = records.sparkSession
    keys = sample_keys(records, salt)
    time = keys.schema["first_loaded"].dataType
    reached = [(F.col("first_loaded") >= F.lit(c).cast(time)).cast("int") for c in cutoffs]
    arrival = F.when(F.col("first_loaded").isNull(), len(cutoffs)).otherwise(sum(reached, F.lit(0)))
    keys = stage(keys.withColumn("arrival", arrival), "p5-keys")
    ledger = spark.read.schema(_LEDGER).parquet(folder) if folder else empty_ledger(spark)
    folder = folder or new_folder(spark, "p5-ledger")
    steps = len(cutoffs) + open_step
    new = new_entries(ledger, keys.where(F.col("arrival") < steps).select("stratum", "key", "priority", "arrival"), per_mille, steps)
    new.write.mode("append").parquet(folder)
    return spark.read.schema(_LEDGER).parquet(folder).join(keys.select("key", "keep_no", "n_rows"), "key")
