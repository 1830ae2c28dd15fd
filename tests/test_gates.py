import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators import gates as G
from quillon.operators import inference as I
from quillon.operators import retrieval as R
from quillon.sources import readers, sinks


def test_tables_within_their_bounds(spark):
    mine = spark.createDataFrame([("a", 1.0, "exact"), ("b", 2.0, "exact"), ("c", 3.0, "loose"), ("d", 4.0, "other")], "k string, v double, kind string")
    golden = spark.createDataFrame([("a", 1.0), ("b", 2.0 + 1e-8), ("c", 3.004), ("e", 1.0), ("d", None)], "k string, v double")
    got = {r.kind: (r.n_cells, r.ok) for r in G.expect_close(mine, golden, ["k"], "v", "kind", {"exact": 1e-9, "loose": 6e-3}).collect()}
    assert got == {"exact": (2, False), "loose": (1, True), "other": (1, False), None: (1, False)}
    assert G.expect_close(mine.limit(0), golden.limit(0), ["k"], "v", "kind", {"exact": 1e-9}).count() == 0


def test_buffered_direction(spark):
    df = spark.createDataFrame([(0.30, 0.25), (0.30, 0.25)], "h double, m double")
    ok = {r.gate: r.ok for r in G.report([G.expect_not_above(df, str(b), F.avg("h"), F.avg("m"), b) for b in (0.01, 0.1)]).collect()}
    assert ok == {"0.01": False, "0.1": True}


def test_ranks_over_ranges_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(i, "big" if rng.random() < 0.8 else "small", rng.choice([None, rng.randrange(40), 7])) for i in range(600)]
    got = {r.i: r.rank for r in I.average_ranks(spark.createDataFrame(rows, "i long, g string, v int").repartition(5), ["g"], "v").collect()}
    want = {}
    for i, g, v in rows:
        if v is not None:
            others = [w for _, h, w in rows if h == g and w is not None]
            want[i] = sum(w < v for w in others) + (others.count(v) + 1) / 2
    assert got == want


@pytest.mark.parametrize("texts", [["It ROSE, then fell.", "halfway up", "half way; U shaped; the 3rd", "nothing"], V.ORDER_CLAIMS])
def test_prefilter_loses_no_pattern(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    got = {r.k: r.m for r in df.select("k", T.matched(F.col("t"), V.ORDER_CLAIMS).alias("m")).collect()}
    assert got == {k: [p for p in V.ORDER_CLAIMS if re.search(V.either([p]), t)] for k, t in enumerate(texts)}
    assert T.beginning("vary\\w*|varied") == "" and T.beginning("late[rst]*") == "late" and T.beginning("dipp?") == "dip" and T.beginning("half?way") == "hal"


def test_files_written_and_repaired(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = [("0000001", [1.0, 2.5]), ("0000002", [3.0]), ("0000003", None)]
    df = spark.createDataFrame(rows, "name string, x array<double>").where("x is not null")
    for _ in range(2):  # written again without harm
        sinks.write_files(df.select(F.concat(F.lit("npy/"), "name", F.lit(".npy")).alias("name"), sinks.npy_content("x").alias("content")), folder)
    csv = F.encode(F.array_join(F.transform("x", lambda v: v.cast("string")), "\n"), "UTF-8")
    sinks.write_files(df.select(F.concat(F.lit("csv/"), "name", F.lit(".csv")).alias("name"), csv.alias("content")), folder)
    (tmp_path / "out/npy/0000002.npy").write_bytes(b"torn")
    (tmp_path / "out/npy/0000009.npy").write_bytes(b"torn, and no signal of that name")
    audit = lambda: {r.file[-11:]: (r.status == "ok", r.n) for r in readers.audit_npy(spark, folder + "/npy").collect()}
    assert audit() == {"0000001.npy": (True, 2), "0000002.npy": (False, None), "0000009.npy": (False, None)}
    sinks.repair_npy(readers.audit_npy(spark, folder + "/npy"), readers.signal_files(spark, folder + "/csv"), folder + "/npy")
    assert audit() == {"0000001.npy": (True, 2), "0000002.npy": (True, 1), "0000009.npy": (False, None)}


def test_encoder_waits_and_checks_its_vectors(spark, tmp_path):
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    with pytest.raises(Exception, match="vectors of shape"):
        sinks.encode_missing(texts.coalesce(1), spark, f"{tmp_path}/bad", lambda ts: __import__("numpy").zeros((len(ts) + 1, 4)), retries=1)
    marks = str(tmp_path / "tries")

    def flaky(ts):
        import os

        import numpy as np

        with open(marks, "a") as f:
            f.write("x")
        if os.path.getsize(marks) < 3:
            raise OSError("not yet")
        return np.ones((len(ts), 4))

    assert sinks.encode_missing(texts.coalesce(1), spark, f"{tmp_path}/good", flaky, wait=0.01) == 2


def test_best_score_by_label(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], rng.choice(["x", "y", None])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label string")
    got = {(r.query_id, r.label): r.best for r in R.best_by_label(df, df).collect()}
    want = {}
    for i, v, _ in rows:
        for j, w, label in rows:
            if i != j and label:
                s = round(sum(a * b for a, b in zip(v, w)), 9)
                want[i, label] = max(want.get((i, label), -9), s)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
