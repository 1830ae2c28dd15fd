"""Files as evaluation data comes in: signal files, encodings, archives and arrays, written from the tables and read back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillon.functions.numbers import rounded
from quillon.operators import gates as G
from quillon.plans import base as B
from quillon.plans.audit_queries import _LADDER, ladder
from quillon.plans.registry import query
from quillon.session import new_folder, read_table
from quillon.sources import readers as R
from quillon.sources import sinks as S

_M = f"""WITH {B.POOL_SQL}, m AS (SELECT idx, x FROM manual_validation_sample LEFT JOIN pool USING (sample_id))"""


def signals(spark, sf):
    """(idx, name, x): the series of each judged item's sample, null where the sample has none."""
    m = read_table(spark, sf, "manual_validation_sample").select("idx", "sample_id")
    return m.join(B.pool(spark, sf), "sample_id", "left").select("idx", F.lpad(F.col("idx").cast("string"), 7, "0").alias("name"), "x")


def csv_content(x):
    return F.encode(F.array_join(F.transform(x, lambda v: v.cast("string")), "\n"), "UTF-8")


@query(f"{_M} SELECT idx, x IS NOT NULL AS found, coalesce(len(x), 0) AS n_points FROM m")
def signal_join(spark, sf):
    """SRC-02, SRC-15: metadata joined to one signal file per row in nested folders, other files passed over, missing ones
    reported."""
    path = new_folder(spark, "signals")
    s = signals(spark, sf)
    held = s.where("x is not null")
    folder = F.concat(F.lit("part"), (F.col("idx") % 7).cast("string"), F.lit("/"))
    S.write_files(held.select(F.concat(folder, "name", F.lit(".csv")).alias("name"), csv_content(F.col("x")).alias("content")), path)
    S.write_files(held.select(F.concat(folder, F.lit("notes_"), "name", F.lit(".csv")).alias("name"), F.encode(F.lit("no signal"), "UTF-8").alias("content")), path)
    meta = s.select("idx", F.concat(F.lit("D:\\signals\\"), "name", F.lit(".csv")).alias("file"))
    found, missing = R.metadata_with_signals(meta, R.signal_files(spark, path), "file")
    return found.select("idx", F.lit(True).alias("found"), F.size("series").cast("long").alias("n_points")).unionByName(
        missing.select("idx", F.lit(False).alias("found"), F.lit(0).cast("long").alias("n_points"))
    )


@query("""SELECT CASE idx % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gbk' ELSE 'cp1252' END AS encoding, count(*) AS n_files, sum(length(caption_correct) + CASE idx % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 5 END)::BIGINT AS n_chars
FROM manual_validation_sample WHERE caption_correct IS NOT NULL GROUP BY 1""")
def encoded_files(spark, sf):
    """SRC-08, STR-25: text files in three encodings, one of them with a byte-order mark, decoded and diagnosed."""

    @F.pandas_udf("binary")
    def encoded(idx: pd.Series, text: pd.Series) -> pd.Series:
        kinds = [("utf-8-sig", " \u00e9\u2014x"), ("gbk", " \u6d4b\u8bd5"), ("cp1252", " caf\u00e9")]
        return pd.Series([(t + kinds[i % 3][1]).encode(kinds[i % 3][0]) for i, t in zip(idx, text)])

    path = new_folder(spark, "encoded")
    m = read_table(spark, sf, "manual_validation_sample").where("caption_correct is not null")
    S.write_files(m.select(F.concat(F.col("idx").cast("string"), F.lit(".txt")).alias("name"), encoded("idx", "caption_correct").alias("content")), path)
    return R.decoded_files(spark, path).groupBy("encoding").agg(F.count("*").alias("n_files"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("""SELECT count(*) FILTER (idx % 5 <> 0) AS n_read, count(*) FILTER (idx % 5 = 0) AS n_bad, sum(length(caption_correct)) FILTER (idx % 5 <> 0)::BIGINT AS n_bytes
FROM manual_validation_sample WHERE caption_correct IS NOT NULL AND length(caption_correct) = octet_length(encode(caption_correct))""")
def archive_members(spark, sf):
    """SRC-13: archives of ten members each, whose damaged members are reported and do not spoil the others."""

    @F.pandas_udf("binary")
    def archive(members: pd.Series) -> pd.Series:
        out = []
        for rows in members:
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                for r in rows:
                    z.writestr(f"{r['idx']}.txt", r["caption_correct"])
            data = bytearray(held.getvalue())
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                spoilt = [i.header_offset + 30 + len(i.filename) for i in z.infolist() if int(i.filename[:-4]) % 5 == 0]
            for at in spoilt:
                data[at] ^= 0xFF  # the content no longer fits its checksum
            out.append(bytes(data))
        return pd.Series(out)

    path = new_folder(spark, "archives")
    m = read_table(spark, sf, "manual_validation_sample").where("caption_correct is not null and length(caption_correct) = octet_length(caption_correct)")
    ten = m.groupBy(F.floor(F.col("idx") / 10).alias("b")).agg(F.collect_list(F.struct("idx", "caption_correct")).alias("rows"))
    S.write_files(ten.select(F.concat(F.col("b").cast("string"), F.lit(".zip")).alias("name"), archive("rows").alias("content")), path)
    z = R.zip_members(spark, path)
    return z.agg(F.count("content").alias("n_read"), F.count("error").alias("n_bad"), F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


@query(f"{_M} SELECT count(*) AS n_files, count(*) FILTER (idx % 4 = 0) AS n_broken, 0::BIGINT AS n_broken_after, sum(len(x))::BIGINT AS n_points FROM m WHERE x IS NOT NULL")
def array_file_repair(spark, sf):
    """SRC-14: ``.npy`` files audited, those that do not load written anew from the CSV of the same name, audited again."""
    csv, npy = new_folder(spark, "csv"), new_folder(spark, "npy")
    held = signals(spark, sf).where("x is not null")
    S.write_files(held.select(F.concat("name", F.lit(".csv")).alias("name"), csv_content(F.col("x")).alias("content")), csv)
    content = F.when(F.col("idx") % 4 == 0, F.encode(F.lit("torn"), "UTF-8")).otherwise(S.npy_content("x"))
    S.write_files(held.select(F.concat("name", F.lit(".npy")).alias("name"), content.alias("content")), npy)
    before = R.audit_npy(spark, npy).agg(F.count("*").alias("n_files"), F.count_if(F.col("status") != "ok").alias("n_broken")).first()  # two counts
    S.repair_npy(R.audit_npy(spark, npy), R.signal_files(spark, csv), npy)
    after = R.audit_npy(spark, npy)
    return after.agg(
        F.lit(before.n_files).cast("long").alias("n_files"), F.lit(before.n_broken).cast("long").alias("n_broken"), F.count_if(F.col("status") != "ok").alias("n_broken_after"), F.sum("n").alias("n_points")
    )


@query(f"""WITH {B.SCORES_SQL}, t AS (SELECT seed, component, avg((margin >= 0)::INT) AS stored, avg(CASE WHEN margin > 0 THEN 1.0 WHEN margin = 0 THEN 0.5 ELSE 0.0 END::DOUBLE) AS mine, count(*) FILTER (margin = 0) > 0 AS tied FROM scores GROUP BY seed, component)
SELECT CASE WHEN tied THEN 'tie-exposed' ELSE 'tie-immune' END AS kind, count(*) AS n_cells, round(max(abs(stored - mine)), 6) AS deviation, max(abs(stored - mine)) <= CASE WHEN tied THEN 0.5 ELSE 1e-9 END AS ok FROM t GROUP BY tied""")
def reproduced_metrics(spark, sf):
    """GAT-04: a frozen accuracy table, which counts ties as right, against one recomputed with ties as half: cells without
    ties must agree to the digit, the others within what ties can explain (half of a cell's rows at most)."""
    s = B.scores(spark, sf)
    cell = ["seed", "component"]
    path = new_folder(spark, "frozen")
    S.write_json_lines(s.groupBy(*cell).agg(F.avg((F.col("margin") >= 0).cast("double")).alias("accuracy")), path)
    frozen = spark.read.schema("seed string, component string, accuracy double").json(path)
    right = F.when(F.col("margin") > 0, 1.0).when(F.col("margin") == 0, 0.5).otherwise(0.0)
    mine = s.groupBy(*cell).agg(F.avg(right).alias("accuracy"), (F.count_if(F.col("margin") == 0) > 0).alias("tied"))
    kind = F.when(F.col("tied"), "tie-exposed").otherwise("tie-immune")
    return G.expect_close(mine.withColumn("kind", kind), frozen, cell, "accuracy", "kind", {"tie-immune": 1e-9, "tie-exposed": 0.5}).withColumn("deviation", rounded("deviation", 6))


@query(f"WITH {B.SCORES_SQL} SELECT 'mean margin' AS kind, count(DISTINCT (seed, component, probe_condition)) AS n_cells, 0.0::DOUBLE AS deviation, true AS ok FROM scores")
def summary_reproduced(spark, sf):
    """GAT-05: metrics recomputed from the records equal the runner's summary of sums and counts."""
    s = B.scores(spark, sf)
    cell = ["seed", "component", "probe_condition"]
    path = new_folder(spark, "summary")
    S.write_json_lines(s.groupBy(*cell).agg(F.sum("margin").alias("total"), F.count("*").alias("n")), path)
    summary = spark.read.schema("seed string, component string, probe_condition string, total double, n long").json(path).select(*cell, (F.col("total") / F.col("n")).alias("margin"))
    mine = s.groupBy(*cell).agg(F.avg("margin").alias("margin")).withColumn("kind", F.lit("mean margin"))
    return G.expect_close(mine, summary, cell, "margin", "kind", {"mean margin": 1e-9}).withColumn("deviation", rounded("deviation", 6))


@query(f"""{_LADDER}, m AS (SELECT avg(1 / rank) FILTER (condition = 'masking') AS mild, avg(1 / rank) FILTER (condition = 'reverse') AS harsh, avg(1 / rank) FILTER (condition = 'unperturbed') AS whole FROM r)
SELECT 'harsh not above mild' AS gate, harsh <= mild + 0.02 AS ok, true AS hard FROM m UNION ALL SELECT 'mild not above whole', mild <= whole + 0.02, true FROM m""")
def direction_sanity(spark, sf):
    """GAT-09: a harsher perturbation must not beat a milder one by more than a buffer, nor that the whole series."""
    r = ladder(spark, sf)
    mrr = lambda c: F.avg(F.when(F.col("condition") == c, 1 / F.col("rank")))
    gates = [
        G.expect_not_above(r, "harsh not above mild", mrr("reverse"), mrr("masking"), 0.02),
        G.expect_not_above(r, "mild not above whole", mrr("masking"), mrr("unperturbed"), 0.02),
    ]
    return G.report(gates).select("gate", "ok", "hard")


@query("SELECT unnest(['spark.version', 'spark.sql.shuffle.partitions', 'spark.sql.session.timeZone', 'spark.sql.adaptive.enabled']) AS key, true AS known")
def environment_report(spark, sf):
    """GAT-18: versions and settings of the run, report-only."""
    return G.environment(spark).select("key", F.col("value").isNotNull().alias("known"))


def _features(spark, sf):
    from quillon.operators.features import series_features

    rows = read_table(spark, sf, "pairs").where("sample_id is not null and size(series) > 0").groupBy("sample_id")
    first = rows.agg(F.min_by(F.struct("series", "dataset"), "pair_no").alias("r")).select("sample_id", "r.series", "r.dataset")
    return first.select("sample_id", "dataset"), series_features(first.select("sample_id", F.col("series").alias("x")), "sample_id", "x")


@query(f"""WITH {B.POOL_SQL} SELECT count(*) AS n, count(*) AS n_same, 1::BIGINT AS n_models FROM pool WHERE len(x) >= 4 AND list_max(x) > list_min(x)""")
def model_roundtrip(spark, sf):
    """SNK-09: a classifier fitted, written and read again predicts the same."""
    from quillon.operators import ml

    label, features = _features(spark, sf)
    rows = features.join(label.select("sample_id", (F.col("dataset") == "sushi").cast("double").alias("label")), "sample_id").na.fill(0.0)
    path = new_folder(spark, "model")
    fitted = ml.fit(rows, [c for c in features.columns if c != "sample_id"])
    ml.save(fitted, path)
    again = ml.load(path)
    both = again.transform(fitted.transform(rows).select(*rows.columns, F.col("prediction").alias("first"))).select("first", "prediction")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("prediction")).alias("n_same"), F.lit(1).cast("long").alias("n_models"))
