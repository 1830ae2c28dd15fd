import io
import zipfile

import numpy as np
from pyspark.sql import functions as F

from quillon.sources import readers as R
from quillon.sources import sinks as S
from quillon.streaming import events as E


def test_encodings(spark, tmp_path):
    for name, text, encoding in (("a", "é plain", "utf-8"), ("b", "中文", "gbk"), ("c", "\x80\xff", "latin-1")):
        (tmp_path / name).write_bytes(text.encode(encoding))
    (tmp_path / "d").write_bytes("﻿marked".encode())
    got = {r.file.rpartition("/")[2]: (r.encoding, r.text) for r in R.decoded_files(spark, str(tmp_path)).collect()}
    assert got["a"] == ("utf-8", "é plain") and got["b"] == ("gbk", "中文") and got["c"][0] == "cp1252" and got["d"] == ("utf-8", "marked")


def test_archives_and_arrays(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("m.txt", "hello")
    (tmp_path / "y.zip").write_bytes(b"broken")
    got = {r.archive.rpartition("/")[2]: r for r in R.zip_members(spark, str(tmp_path / "*.zip")).collect()}
    assert bytes(got["x.zip"].content) == b"hello" and got["y.zip"].error == "BadZipFile"
    buffer = io.BytesIO()
    np.save(buffer, np.array([1.0, np.inf]))
    (tmp_path / "a.npy").write_bytes(buffer.getvalue())
    (tmp_path / "b.npy").write_bytes(b"nothing")
    got = {r.file.rpartition("/")[2]: r for r in R.audit_npy(spark, str(tmp_path / "*.npy")).collect()}
    assert got["a.npy"].status == "ok" and got["a.npy"].n == 2 and got["a.npy"].finite is False and got["b.npy"].status != "ok"


def test_signals_and_metadata(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "0000001.csv").write_text("1.5\n2.5\n")
    (tmp_path / "0000002.csv").write_text("1,2,x,3")
    (tmp_path / "readme.csv").write_text("9")
    signals = R.signal_files(spark, str(tmp_path))
    assert {tuple(r.series) for r in signals.collect()} == {(1.5, 2.5), (1.0, 2.0, 3.0)}
    meta = spark.createDataFrame([("a\\0000001.csv",), ("b/0000009.csv",)], "path string")
    found, missing = R.metadata_with_signals(meta, signals, "path")
    assert found.count() == 1 and missing.first().path == "b/0000009.csv"


def test_keyed_json_and_annotations(spark, tmp_path):
    (tmp_path / "k.json").write_text('{"a": {"id": "a", "n": 1}, "b": {"id": "b"}}')
    assert {(r.key, r.value.n) for r in R.keyed_json(spark, str(tmp_path / "k.json"), "id string, n int").collect()} == {("a", 1), ("b", None)}
    raw = spark.createDataFrame([('["x", "y"]',), ('[["x"], ["z"]]',), (None,)], "raw string")
    assert [r.t for r in raw.select(R.annotation_texts(F.col("raw")).alias("t")).collect()] == [["x", "y"], ["x", "z"], None]


def test_sheets_keep_quotes_and_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None)], "idx int, t string")
    S.write_sheet(df, str(tmp_path / "s"), ["verdict"], banner="judge each row", mark=True)
    text = next((tmp_path / "s").glob("part-*")).read_text()
    assert text.startswith("﻿# judge each row\nidx,t,verdict\n")
    S.write_sheet(df, str(tmp_path / "p"), ["verdict"], banner="judge each row")
    got = R.judgment_sheet(spark, str(tmp_path / "p"), "idx int, t string, verdict string").collect()
    assert {(r.idx, r.t) for r in got} == {(1, 'say "hi", you'), (2, None)}


def test_resume_and_retry(spark, tmp_path):
    jobs = spark.createDataFrame([(i,) for i in range(5)], "k int")
    path = str(tmp_path / "out")
    assert [S.resume(j, spark, path, ["k"], lambda x: x) for j in (jobs.limit(2), jobs, jobs)] == [2, 3, 0]
    assert spark.read.parquet(path).count() == 5
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")
    assert S.encode_missing(texts, spark, str(tmp_path / "cache"), S.hash_encoder(4)) == 2
    assert S.encode_missing(texts, spark, str(tmp_path / "cache"), S.hash_encoder(4)) == 0


def test_stream_windows_slide(spark):
    stream = E.event_stream(spark, "/root/testdata/sf0.001")
    out = E.run_complete(E.windowed_counts(stream, "2 hours", "1 hour"), spark, "slide")
    assert out.agg(F.sum("n")).first()[0] == 2 * spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
