"""Sources and sinks: what is written in a format and read back must equal the table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions.numbers import rounded
from quillon.operators import ml
from quillon.operators.features import series_features
from quillon.plans import base as B
from quillon.plans.registry import query
from quillon.session import new_folder, read_table, stage
from quillon.sources import readers as R
from quillon.sources import sinks as S
from quillon.streaming import events as E

_OK = "ok AS (SELECT line_id, file_name, line_text::JSON AS j FROM (SELECT * FROM pair_lines WHERE json_valid(line_text)) WHERE json_type(line_text) = 'OBJECT')"


@query(f"WITH {_OK} SELECT line_id, j->>'dataset' AS dataset, j->>'caption_id' AS caption_id, len(CAST(j->'series' AS DOUBLE[])) AS n, j->>'class_label' AS class_label FROM ok")
def jsonl_scan(spark, sf):
    """SRC-04, JSN-01, JSN-02, JSN-04: JSON lines under a fixed schema, ragged keys as nulls."""
    rec = R.json_records(read_table(spark, sf, "pair_lines"), "line_text", R.PAIR_JSON).where("not broken")
    return rec.select("line_id", "rec.dataset", "rec.caption_id", F.size("rec.series").cast("long").alias("n"), "rec.class_label")


@query(f"""WITH {_OK} SELECT CASE WHEN j IS NULL THEN 'broken' WHEN j->>'split' IS NULL THEN 'no split' WHEN trim(j->>'sample_id') <> j->>'sample_id' THEN 'blanks' ELSE 'fine' END AS reason, count(*) AS n
FROM pair_lines LEFT JOIN ok USING (line_id) GROUP BY 1""")
def quarantine(spark, sf):
    """GAT-16, FLT-08: bad records with reasons instead of failures."""
    rec = R.json_records(read_table(spark, sf, "pair_lines"), "line_text", R.PAIR_JSON)
    sample = F.col("rec.sample_id")
    reason = F.when(F.col("broken"), "broken").when(F.col("rec.split").isNull(), "no split").when(F.trim(sample) != sample, "blanks").otherwise("fine")
    return rec.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT file_name, count(*) AS n, count(DISTINCT line_id) AS n_ids, min(line_id) AS first, max(line_id) - min(line_id) + 1 = count(*) AS contiguous FROM pair_lines GROUP BY file_name")
def file_gates(spark, sf):
    """GAT-17: per file rows, ids and contiguity."""
    g = read_table(spark, sf, "pair_lines").groupBy("file_name")
    return g.agg(F.count("*").alias("n"), F.countDistinct("line_id").alias("n_ids"), F.min("line_id").alias("first"), (F.max("line_id") - F.min("line_id") + 1 == F.count("*")).alias("contiguous"))


@query("SELECT dataset, sample_id, count(caption) AS n_annotations, len(arg_min(series, pair_no)) AS n_points FROM pairs WHERE sample_id IS NOT NULL AND dataset IS NOT NULL AND series IS NOT NULL GROUP BY dataset, sample_id")
def keyed_object_json(spark, sf):
    """SRC-01, JSN-03, M12: objects keyed by id, annotations as lists or lists of lists, a folder of files per corpus. A file's
    object holds about 200 entries, so none outgrows a row however many there are."""
    rows = read_table(spark, sf, "pairs").where("sample_id is not null and dataset is not null and series is not null")
    one = rows.groupBy("dataset", "sample_id").agg(F.collect_list("caption").alias("a"), F.min_by("series", "pair_no").alias("series"))
    one = stage(one, "keyed-entries")
    files = max(1, one.count() // 200)
    raw = F.when(F.pmod(F.xxhash64("sample_id"), F.lit(2)) == 0, F.to_json("a")).otherwise(F.to_json(F.array("a")))
    entry = F.struct(F.col("sample_id").alias("key"), F.struct(raw.alias("annotations"), "series").alias("value"))
    objects = one.groupBy("dataset", F.pmod(F.xxhash64("sample_id", F.lit(3)), F.lit(files)).alias("b")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    path = new_folder(spark, "keyed")
    objects.select("dataset", "value").write.partitionBy("dataset").text(path)
    # a text file may hold several objects: read by line, each an object
    lines = spark.read.schema("value string, dataset string").text(path)
    back = lines.select("dataset", F.explode(F.from_json("value", "map<string,struct<annotations:string,series:array<double>>>")).alias("sample_id", "v"))
    return back.select("dataset", "sample_id", F.size(R.annotation_texts(F.col("v.annotations"))).cast("long").alias("n_annotations"), F.size("v.series").cast("long").alias("n_points"))


@query("SELECT dataset, split, count(*) AS n, min(pair_no) AS first FROM pairs WHERE dataset = 'sushi' GROUP BY dataset, split")
def partitioned_pairs(spark, sf):
    """SNK-01, SRC-03: written by dataset and split, read back with partition pruning."""
    path = new_folder(spark, "pairs")
    S.write_pairs(read_table(spark, sf, "pairs").select("pair_no", "dataset", "split", "caption"), path)
    back = spark.read.schema("pair_no long, caption string, dataset string, split string").parquet(path)
    return back.where("dataset = 'sushi'").groupBy("dataset", "split").agg(F.count("*").alias("n"), F.min("pair_no").alias("first"))


@query("SELECT idx, coalesce(component, '') AS component, coalesce(caption_correct, '') AS caption_correct, '' AS verdict FROM manual_validation_sample")
def sheet_roundtrip(spark, sf):
    """SNK-04, SRC-09, SRC-08: judgment sheet with banner, mark and empty verdicts, read back."""
    path = new_folder(spark, "sheet")
    m = read_table(spark, sf, "manual_validation_sample").select("idx", "component", "caption_correct")
    S.write_sheet(m, path, ["verdict"], banner="one row per item, answer y or n", mark=False)
    back = R.judgment_sheet(spark, path, "idx long, component string, caption_correct string, verdict string")
    return back.select("idx", *[F.coalesce(c, F.lit("")).alias(c) for c in ("component", "caption_correct", "verdict")])


@query("SELECT item_id AS id FROM probe1_items")
def id_list_roundtrip(spark, sf):
    """SRC-10, SNK-08: id list of all items with comments."""
    return id_list(spark, read_table(spark, sf, "probe1_items"))


def id_list(spark, items):
    path = new_folder(spark, "ids")
    ids = items.select(F.explode(F.array(F.concat("item_id", F.lit("  # defect")), F.lit("# a comment"), F.lit(""))).alias("value"))
    ids.write.text(path)
    return R.id_list(spark, path)


@query("SELECT item_id, seed, margin FROM item_scores WHERE margin::VARCHAR <> 'nan'")
def json_lines_roundtrip(spark, sf):
    """SNK-02, SNK-03: per-item records as JSON lines."""
    path = new_folder(spark, "jsonl")
    S.write_json_lines(read_table(spark, sf, "item_scores").where("not isnan(margin) and margin is not null").select("item_id", "seed", "margin"), path)
    return spark.read.schema("item_id string, seed string, margin double").json(path)


@query("SELECT p_brand AS brand, count(*) AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand")
def struct_scan(spark, sf):
    """SRC-06, M17: struct column written and read with nested column pruning."""
    path = new_folder(spark, "struct")
    read_table(spark, sf, "part").select("p_partkey", F.struct("p_brand", "p_size", "p_type").alias("description")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("description.p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("description.p_size").cast("long").alias("sizes"))


@query("""WITH t AS (SELECT DISTINCT caption AS t FROM pairs WHERE caption IS NOT NULL), h AS (SELECT DISTINCT t FROM t WHERE md5(t) < '8')
SELECT (SELECT count(*) FROM h) AS first_run, (SELECT count(*) FROM t) - (SELECT count(*) FROM h) AS second_run, 0::BIGINT AS third_run, (SELECT count(*) FROM t) AS cached, 1.0::DOUBLE AS norm""")
def encoder_cache_miss(spark, sf):
    """SRC-11, SRC-12, SRC-17, SNK-06, O4, O5: distinct texts encoded once, misses by anti-join, cache appended."""
    cache = new_folder(spark, "cache")
    texts = read_table(spark, sf, "pairs").select(F.col("caption").alias("text"))
    runs = [S.encode_missing(t, spark, cache, S.hash_encoder()) for t in (texts.where(F.md5("text") < "8"), texts, texts)]
    back = spark.read.parquet(cache)
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v))
    return back.agg(*[F.lit(n).cast("long").alias(k) for n, k in zip(runs, ("first_run", "second_run", "third_run"))], F.count("*").alias("cached"), rounded(F.avg(norm), 4).alias("norm"))


@query("SELECT probe_condition, count(*) AS n, count(DISTINCT item_id) AS n_items FROM probe1_items GROUP BY probe_condition")
def resume_append(spark, sf):
    """SNK-05: an interrupted run resumed without repeating or losing a job."""
    path = new_folder(spark, "resume")
    jobs = read_table(spark, sf, "probe1_items").select("item_id", "probe_condition")
    for part in (jobs.where(F.md5("item_id") < "9"), jobs, jobs):
        S.resume(part, spark, path, ["item_id", "probe_condition"], lambda left: left)
    return spark.read.parquet(path).groupBy("probe_condition").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents WHERE text IS NOT NULL)
SELECT doc_id, nr, line FROM l WHERE regexp_matches(line, '(seed|probe) [0-9]+')""")
def line_scan(spark, sf):
    """SRC-16: lines of texts matched by a pattern, with their numbers."""
    lines = read_table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return lines.where(F.col("line").rlike("(seed|probe) [0-9]+")).select("doc_id", (F.col("p") + 1).cast("long").alias("nr"), "line")


@query("""WITH ok AS (SELECT line_text::JSON AS j FROM (SELECT * FROM pair_lines WHERE json_valid(line_text)) WHERE json_type(line_text) = 'OBJECT')
SELECT array_to_string(list_sort(json_keys(j)), ',') AS keys, count(*) AS n FROM ok GROUP BY 1""")
def json_shapes(spark, sf):
    """SRC-20: the shapes of JSON lines and how often each occurs."""
    valid = R.json_records(read_table(spark, sf, "pair_lines"), "line_text", R.PAIR_JSON).where("not broken")
    return valid.select(F.array_join(F.array_sort(F.json_object_keys("line_text")), ",").alias("keys")).groupBy("keys").agg(F.count("*").alias("n"))


@query()
def encode_series_batches(spark, sf):
    """MLO-04, ARR-16: batched encoder over series of equal length (a random projection stands in for a model)."""
    pool = B.pool(spark, sf).select(F.col("sample_id").alias("id"), "x")
    return ml.encode_series(pool).select("id", F.size("vec").alias("width"), rounded(F.get("vec", F.lit(0)), 4).alias("first"))


@query()
def logreg_cv(spark, sf):
    """MLO-01, MLO-02: out-of-fold accuracy of a classifier over series features, overall and on samples with items."""
    pool = B.pool(spark, sf).where("size(x) >= 4")
    features = series_features(pool, "sample_id", "x").withColumn("label", F.when(F.startswith("sample_id", F.lit("truce_synth")), "synth").when(F.startswith("sample_id", F.lit("truce_stock")), "stock"))
    columns = [c for c in features.columns if c not in ("sample_id", "label")]
    predicted = ml.cross_validate(features.where("label is not null"), "label", columns, "sample_id")
    return predicted.groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(F.col("right").cast("double")), 4).alias("accuracy"))


_TS = "date_trunc('hour', ts)"


@query(f"SELECT {_TS} AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_stream_hourly(spark, sf):
    """Extension: tumbling windows of a stream with a watermark."""
    out = E.run_complete(E.windowed_counts(E.event_stream(spark, sf), "1 hour"), spark, "hourly")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, s""")
def ext_stream_sessions(spark, sf):
    """Extension: session windows of a stream."""
    out = E.run_complete(E.sessions(E.event_stream(spark, sf)), spark, "sessions")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""SELECT e.event_id, coalesce(v.event_id, -1) AS last_view FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def ext_asof_join(spark, sf):
    """Extension: as-of join as one sort per user over the union of both sides, without a range join."""
    e = read_table(spark, sf, "events").where(F.col("event_type").isin("error", "view"))
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    rank = F.when(F.col("event_type") == "view", 0).otherwise(1)
    w = W.partitionBy("user_id").orderBy("ts", rank, "event_id").rowsBetween(W.unboundedPreceding, 0)
    return e.withColumn("last_view", F.last(view, ignorenulls=True).over(w)).where("event_type = 'error'").select("event_id", F.coalesce("last_view", F.lit(-1)).alias("last_view"))
