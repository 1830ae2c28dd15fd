"""Projections, filters, joins, set operations and gates over scores, items and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import arrays as A
from quillon.functions.numbers import rounded
from quillon.operators import gates as G
from quillon.operators import items as I
from quillon.operators import retrieval as R
from quillon.plans import base as B
from quillon.plans.registry import query
from quillon.plans.retrieval_queries import _E
from quillon.session import read_table, stage

_S = f"WITH {B.SCORES_SQL}"


@query("SELECT dataset, split, count(*) AS n, count(DISTINCT sample_id) AS n_samples FROM pairs WHERE split IN ('val', 'test') AND dataset IN ('truce_synth', 'sushi') GROUP BY dataset, split")
def filtered_scan(spark, sf):
    """SRC-03, FLT-01, AGG-01, AGG-04: splits and datasets pushed into the scan."""
    p = read_table(spark, sf, "pairs").where(F.col("split").isin("val", "test") & F.col("dataset").isin("truce_synth", "sushi"))
    return p.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.countDistinct("sample_id").alias("n_samples"))


@query("SELECT count(*) AS n_rows FROM pairs")
def footer_count(spark, sf):
    """SRC-07: row count from Parquet footers."""
    return read_table(spark, sf, "pairs").agg(F.count("*").alias("n_rows"))


@query("""SELECT item_id, regexp_replace(item_id, '\\|[^|]*$', '') AS pair_key, array_to_string(list_filter(string_split(item_id, '|'), lambda t: t NOT IN ('swap', 'random')), '|') AS without_condition,
  list_filter(string_split(item_id, '|'), lambda x: contains(x, ':'))[1] AS sample, CASE WHEN starts_with(sample_id, 'sushi') THEN 'sushi' ELSE 'truce' END AS substrate, len(string_split(item_id, '|')) = 4 AS arity_ok, replace(item_id, 'C4_', 'P4_') AS remapped FROM probe1_items""")
def composite_ids(spark, sf):
    """PRJ-03 to PRJ-07, FLT-03: composite ids taken apart and remapped."""
    i = read_table(spark, sf, "probe1_items")
    parts = F.split("item_id", r"\|")
    return i.select(
        "item_id", I.drop_last_field(F.col("item_id")).alias("pair_key"), F.array_join(F.filter(parts, lambda t: ~t.isin("swap", "random")), "|").alias("without_condition"),
        F.get(F.filter(parts, lambda x: x.contains(":")), F.lit(0)).alias("sample"), F.when(F.startswith("sample_id", F.lit("sushi")), "sushi").otherwise("truce").alias("substrate"), (F.size(parts) == 4).alias("arity_ok"),
        F.replace("item_id", F.lit("C4_"), F.lit("P4_")).alias("remapped"),
    )


@query("""SELECT vec_id, ('v_' || vec_id) AS id, try_cast(regexp_extract('v_' || vec_id, '_(\\d+)$', 1) AS INT) AS row_idx, CASE WHEN label < 3 THEN 'low' WHEN label < 7 THEN 'mid' ELSE 'other' END AS stratum, regexp_extract('run_seed' || label || '.jsonl', 'seed(\\d+)', 1) AS seed FROM embeddings""")
def id_suffixes(spark, sf):
    """PRJ-06, PRJ-14, PRJ-17, PRJ-18: numeric suffix, stratum tag, seed from a file name."""
    e = read_table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("v_"), F.col("vec_id").cast("string")).alias("id"), "label")
    stratum = F.when(F.col("label") < 3, "low").when(F.col("label") < 7, "mid").otherwise("other")
    name = F.concat(F.lit("run_seed"), F.col("label").cast("string"), F.lit(".jsonl"))
    return e.select("vec_id", "id", F.substring_index("id", "_", -1).cast("int").alias("row_idx"), stratum.alias("stratum"), F.regexp_extract(name, r"seed(\d+)", 1).alias("seed"))


@query("SELECT DISTINCT seed, item_id, sim_correct > sim_distractor AS right_choice, sim_correct >= sim_distractor AS readout, round(sim_correct - sim_distractor, 6) AS margin FROM item_scores WHERE sim_correct::VARCHAR <> 'nan' AND sim_distractor::VARCHAR <> 'nan'")
def margin_outcome(spark, sf):
    """PRJ-08, FLT-07: strict forced choice (a tie is wrong) and the readout that takes ties."""
    s = read_table(spark, sf, "item_scores").where("not isnan(sim_correct) and not isnan(sim_distractor) and sim_correct is not null and sim_distractor is not null")
    c, d = F.col("sim_correct"), F.col("sim_distractor")
    return s.select("seed", "item_id", (c > d).alias("right_choice"), (c >= d).alias("readout"), rounded(c - d, 6).alias("margin")).distinct()


@query("SELECT pair_no, caption_id, CAST(k AS BIGINT) AS k, trim(piece, ' ') AS piece, dataset || '#' || k AS new_id FROM (SELECT pair_no, caption_id, dataset, unnest(string_split(caption, '. ')) AS piece, generate_subscripts(string_split(caption, '. '), 1) - 1 AS k FROM pairs WHERE caption IS NOT NULL)")
def explode_captions(spark, sf):
    """PRJ-01, SNK-01: posexplode with ordinals as ids."""
    p = read_table(spark, sf, "pairs").where("caption is not null").select("pair_no", "caption_id", "dataset", F.posexplode(F.split("caption", r"\. ")).alias("k", "piece"))
    return p.select("pair_no", "caption_id", F.col("k").cast("long").alias("k"), F.trim("piece").alias("piece"), F.concat_ws("#", "dataset", "k").alias("new_id"))


@query(f"{_S} SELECT item_id, max(CASE WHEN seed = '42' THEN margin END) AS seed_42, max(CASE WHEN seed = '43' THEN margin END) AS seed_43, max(CASE WHEN seed = '44' THEN margin END) AS seed_44 FROM scores GROUP BY item_id")
def wide_by_seed(spark, sf):
    """PRJ-12: long to wide."""
    return B.scores(spark, sf).groupBy("item_id").pivot("seed", ["42", "43", "44"]).agg(F.max("margin")).withColumnsRenamed({"42": "seed_42", "43": "seed_43", "44": "seed_44"})


@query("UNPIVOT (SELECT pair_no, dataset, split, class_label FROM pairs) ON dataset, split, class_label INTO NAME field VALUE v")
def long_fields(spark, sf):
    """PRJ-12: wide to long, nulls left out."""
    p = read_table(spark, sf, "pairs").select("pair_no", "dataset", "split", "class_label")
    return p.unpivot("pair_no", ["dataset", "split", "class_label"], "field", "v").where("v is not null")


@query("SELECT item_id, CASE WHEN slot = 'fluct' THEN swap_to || '; ' || trim(split_part(source_class, ';', 2), ' ') ELSE trim(split_part(source_class, ';', 1), ' ') || '; ' || swap_to END AS new_class FROM probe1_items WHERE source_class IS NOT NULL")
def swapped_label(spark, sf):
    """PRJ-13: class label with one slot swapped."""
    slot = lambda k: F.trim(F.split_part("source_class", F.lit(";"), F.lit(k)))
    new = F.when(F.col("slot") == "fluct", F.concat_ws("; ", "swap_to", slot(2))).otherwise(F.concat_ws("; ", slot(1), "swap_to"))
    return read_table(spark, sf, "probe1_items").where("source_class is not null").select("item_id", new.alias("new_class"))


@query(f"""WITH {B.POOL_SQL}, i AS (SELECT item_id, sample_id FROM probe1_items) SELECT item_id, len(x) AS n, round(x[1], 6) AS first FROM i JOIN pool USING (sample_id)""")
def items_with_series(spark, sf):
    """JON-01, SRC-05, JON-14: items joined to the first series of their sample, only wanted samples scanned on."""
    i = read_table(spark, sf, "probe1_items").select("item_id", "sample_id")
    p = read_table(spark, sf, "pairs").where("sample_id is not null and size(series) > 0").join(i, "sample_id", "left_semi")
    pool = p.groupBy("sample_id").agg(F.min_by("series", "pair_no").alias("x"))
    return i.join(pool, "sample_id").select("item_id", F.size("x").cast("long").alias("n"), rounded(F.get("x", F.lit(0)), 6).alias("first"))


@query("""WITH i AS (SELECT item_id, md5(caption_correct) AS c, md5(caption_distractor) AS d, sample_id FROM probe1_items), t AS (SELECT md5(t) AS h, any_value(length(t)) AS n FROM (SELECT caption_correct AS t FROM probe1_items UNION SELECT caption_distractor FROM probe1_items) WHERE t IS NOT NULL GROUP BY 1)
SELECT i.item_id, a.n AS n_correct, b.n AS n_distractor FROM i JOIN t a ON a.h = i.c JOIN t b ON b.h = i.d""")
def three_way_join(spark, sf):
    """JON-02, SET-01, O4: distinct texts measured once, joined back twice by content key."""
    i = read_table(spark, sf, "probe1_items")
    texts = i.select(F.explode(F.array("caption_correct", "caption_distractor")).alias("t")).where("t is not null").distinct().select(F.md5("t").alias("h"), F.length("t").cast("long").alias("n"))
    keyed = i.select("item_id", F.md5("caption_correct").alias("c"), F.md5("caption_distractor").alias("d"))
    return keyed.join(texts.select(F.col("h").alias("c"), F.col("n").alias("n_correct")), "c").join(texts.select(F.col("h").alias("d"), F.col("n").alias("n_distractor")), "d").select("item_id", "n_correct", "n_distractor")


@query(f"""{_S}, a AS (SELECT item_id, avg(margin) AS m FROM scores WHERE seed IN ('42', '43') GROUP BY item_id), b AS (SELECT item_id, avg(margin) AS m FROM scores WHERE seed IN ('43', '44') GROUP BY item_id)
SELECT count(*) FILTER (a.item_id IS NULL) AS only_right, count(*) FILTER (b.item_id IS NULL) AS only_left, count(*) AS n, round(max(abs(a.m - b.m)), 6) AS widest, count(*) FILTER (abs(a.m - b.m) <= 1e-9) AS n_equal FROM a FULL JOIN b USING (item_id)""")
def lossless_join_audit(spark, sf):
    """JON-04, JON-05, AGG-19, GAT-03, GAT-06: orphans, agreement and largest gap of two runs."""
    run = lambda seeds, name: B.scores(spark, sf).where(F.col("seed").isin(*seeds)).groupBy("item_id").agg(F.avg("margin").alias(name))
    j = run(["42", "43"], "a").join(run(["43", "44"], "b"), "item_id", "full_outer")
    gap = F.abs(F.col("a") - F.col("b"))
    return j.agg(F.count_if(F.expr("a is null")).alias("only_right"), F.count_if(F.expr("b is null")).alias("only_left"), F.count("*").alias("n"), rounded(F.max(gap), 6).alias("widest"), F.count_if(gap <= 1e-9).alias("n_equal"))


@query("""WITH s AS (SELECT DISTINCT item_id FROM item_scores), i AS (SELECT item_id, component FROM probe1_items) SELECT component, count(*) AS n_items, count(s.item_id) AS n_scored, count(*) - count(s.item_id) AS n_orphans FROM i LEFT JOIN s USING (item_id) GROUP BY component""")
def orphan_census(spark, sf):
    """JON-03, MAP-01, JON-05: dimension join with an orphan count."""
    s = read_table(spark, sf, "item_scores").select("item_id").distinct().withColumn("hit", F.lit(1))
    return read_table(spark, sf, "probe1_items").select("item_id", "component").join(s, "item_id", "left").groupBy("component").agg(
        F.count("*").alias("n_items"), F.count("hit").alias("n_scored"), (F.count("*") - F.count("hit")).alias("n_orphans")
    )


@query("SELECT a.item_id, b.item_id AS twin FROM (SELECT item_id, replace(item_id, '|swap', '|random') AS k FROM probe1_items WHERE probe_condition = 'swap') a JOIN probe1_items b ON a.k = b.item_id")
def remapped_join(spark, sf):
    """JON-06, JON-08: join on a rewritten key."""
    i = read_table(spark, sf, "probe1_items")
    a = i.where("probe_condition = 'swap'").select("item_id", F.replace("item_id", F.lit("|swap"), F.lit("|random")).alias("twin"))
    return a.join(i.select(F.col("item_id").alias("twin")), "twin").select("item_id", "twin")


@query("SELECT pair_key, bool_or(probe_condition = 'swap') AND bool_or(probe_condition = 'random') AS complete, count(DISTINCT probe_condition) AS n_conditions FROM item_scores GROUP BY pair_key")
def twin_shape(spark, sf):
    """JON-08: which pairs have both conditions."""
    c = F.col("probe_condition")
    return read_table(spark, sf, "item_scores").groupBy("pair_key").agg((F.bool_or(c == "swap") & F.bool_or(c == "random")).alias("complete"), F.countDistinct(c).alias("n_conditions"))


@query("""WITH pool AS (SELECT sample_id, min(pair_no) AS no, arg_min(series, pair_no) AS x FROM pairs WHERE sample_id IS NOT NULL AND len(series) > 0 GROUP BY sample_id),
p AS (SELECT a.sample_id AS id, b.sample_id AS other, round(list_max(list_transform(list_zip(a.x, b.x), lambda t: abs(t[1] - t[2]))), 6) AS gap FROM pool a JOIN pool b ON a.sample_id <> b.sample_id AND len(a.x) = len(b.x) WHERE a.no % 50 = 0)
SELECT id, min(gap) AS gap, arg_min(other, struct_pack(g := gap, o := other)) AS nearest, min(gap) < 1e-3 AS duplicate FROM p GROUP BY id""")
def nearest_series(spark, sf):
    """JON-10, JON-20: nearest other series of the same length by largest gap. The query set is every sample whose first
    row's number is divisible by 50, searched against all samples, block by block within a length."""
    rows = read_table(spark, sf, "pairs").where("sample_id is not null and size(series) > 0").groupBy("sample_id")
    s = rows.agg(F.min("pair_no").alias("no"), F.min_by("series", "pair_no").alias("vec")).withColumnRenamed("sample_id", "id").withColumn("length", F.size("vec"))
    s = stage(s, "pool")
    import numpy as np
    import pandas as pd

    n = s.count()

    def run(batches):
        for batch in batches:
            for left, right in zip(batch["querys"], batch["members"]):
                a, b = [r["id"] for r in left], [r["id"] for r in right]
                x, y = np.array([r["vec"] for r in left]), np.array([r["vec"] for r in right])
                order = np.argsort(np.array(b, dtype=object), kind="stable")
                b, y = [b[i] for i in order], y[order]
                gap = np.zeros((len(a), len(b)))
                for j in range(x.shape[1]):
                    np.maximum(gap, np.abs(x[:, j : j + 1] - y[None, :, j]), out=gap)
                gap = np.round(gap, 6)
                gap[np.array(a)[:, None] == np.array(b)[None, :]] = np.inf
                at = gap.argmin(axis=1)
                best = gap[np.arange(len(a)), at]
                yield pd.DataFrame({"id": a, "gap": best, "nearest": [b[i] for i in at]})[np.isfinite(best)]

    asked = s.where("no % 50 = 0").select("id", "vec", "length")
    q = R.blocks(asked, asked.count(), "query", by="length")
    members = R.blocks(s.select("id", "vec", "length"), n, "member", by="length")
    # every query block goes to every member block of its length by number, so a common length is many tasks
    q = q.withColumn("member_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n // R.BLOCK)) - 1).cast("long"))))
    near = q.join(members, ["length", "member_block"]).select("querys", "members").mapInPandas(run, "id string, gap double, nearest string")
    return near.groupBy("id").agg(F.min("gap").alias("gap"), F.min_by("nearest", F.struct("gap", "nearest")).alias("nearest"), (F.min("gap") < 1e-3).alias("duplicate"))


@query("""WITH c AS (SELECT component || ':' || value_a || '/' || value_b AS pair, slot, value_a, value_b FROM component_pairs),
l AS (SELECT pair_no, trim(lower(split_part(class_label, ';', 1)), ' ') AS fluct, trim(lower(split_part(class_label, ';', 2)), ' ') AS shape FROM pairs WHERE class_label IS NOT NULL),
p AS (SELECT pair, slot, value_a, CASE slot WHEN 'shape' THEN shape ELSE fluct END AS v FROM c JOIN l ON CASE slot WHEN 'shape' THEN shape ELSE fluct END IN (value_a, value_b))
SELECT pair, slot, count(*) AS n, count(*) FILTER (v = value_a) AS n_a FROM p GROUP BY pair, slot HAVING count(*) >= 2""")
def pair_populations(spark, sf):
    """JON-17, FLT-06, O17: population of either label of each pair of both slots, each matched with its part of the label."""
    c = read_table(spark, sf, "component_pairs").select(F.concat("component", F.lit(":"), "value_a", F.lit("/"), "value_b").alias("pair"), "slot", "value_a", F.explode(F.array("value_a", "value_b")).alias("v"))
    part = lambda slot, k: F.struct(F.lit(slot).alias("slot"), F.trim(F.lower(F.split_part("class_label", F.lit(";"), F.lit(k)))).alias("v"))
    label = read_table(spark, sf, "pairs").where("class_label is not null").select(F.inline(F.array(part("fluct", 1), part("shape", 2))))
    return label.join(F.broadcast(c), ["slot", "v"]).groupBy("pair", "slot").agg(F.count("*").alias("n"), F.count_if(F.col("v") == F.col("value_a")).alias("n_a")).where("n >= 2")


@query("""WITH a AS (SELECT idx, component, sample_id, swap_to, clause_replaced_to FROM manual_validation_sample), b AS (SELECT component, sample_id, swap_to, clause_replaced_to AS c2, item_id FROM probe1_items WHERE probe_condition = 'swap')
SELECT idx, count(item_id) AS n_items, count(*) FILTER (c2 IS NOT DISTINCT FROM clause_replaced_to AND item_id IS NOT NULL) AS n_same FROM a LEFT JOIN b USING (component, sample_id, swap_to) GROUP BY idx""")
def verify_rebuilt_keys(spark, sf):
    """JON-19: rows rebuilt into item keys, clause text compared exactly."""
    a = read_table(spark, sf, "manual_validation_sample").select("idx", "component", "sample_id", "swap_to", "clause_replaced_to")
    b = read_table(spark, sf, "probe1_items").where("probe_condition = 'swap'").select("component", "sample_id", "swap_to", F.col("clause_replaced_to").alias("c2"), "item_id")
    return a.join(b, ["component", "sample_id", "swap_to"], "left").groupBy("idx").agg(
        F.count("item_id").alias("n_items"), F.count_if(F.col("c2").eqNullSafe(F.col("clause_replaced_to")) & F.col("item_id").isNotNull()).alias("n_same")
    )


@query("WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings), b AS (SELECT vec_id AS other, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) SELECT count(*) AS n, count(*) FILTER (vec_id <> other) AS n_moved, min(i) AS first, max(i) AS last FROM a JOIN b USING (i)")
def positional_join(spark, sf):
    """JON-16, GAT-07: two files joined row by row through contiguous indices of their own, which are counted in ranges."""
    e = read_table(spark, sf, "embeddings").select("vec_id")
    left = row_index(e, "vec_id", "left-index")
    right = row_index(e.select(F.col("vec_id").alias("other")), "other", "right-index")
    return left.join(right, "i").agg(F.count("*").alias("n"), F.count_if(F.expr("vec_id <> other")).alias("n_moved"), F.min("i").alias("first"), F.max("i").alias("last"))


def row_index(df, key, name):
    """``df`` with ``i``, its rows numbered from 0 in the order of ``key`` without one task for all: ranges are staged, the
    sizes of the ranges before are added to the places within a range."""
    spark = df.sparkSession
    ranged = stage(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("part", F.spark_partition_id()), name)
    sizes = ranged.groupBy("part").agg(F.count("*").alias("k"))
    before = sizes.select("part", (F.sum("k").over(W.orderBy("part")) - F.col("k")).alias("before"))  # one row per range
    at = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1 + F.col("before")
    return ranged.join(F.broadcast(before), "part").withColumn("i", at.cast("long")).drop("part", "before")


@query("SELECT component, count(*) FILTER (probe_condition = 'swap') AS swap, count(*) FILTER (probe_condition = 'random') AS random FROM probe1_items GROUP BY component")
def crosstab(spark, sf):
    """AGG-15."""
    return read_table(spark, sf, "probe1_items").groupBy("component").pivot("probe_condition", ["swap", "random"]).count().na.fill(0)


@query("SELECT k AS group_size, count(*) AS n_groups FROM (SELECT caption_id, count(*) AS k FROM pairs GROUP BY caption_id) GROUP BY k")
def group_size_sizes(spark, sf):
    """AGG-13."""
    return read_table(spark, sf, "pairs").groupBy("caption_id").count().groupBy(F.col("count").alias("group_size")).agg(F.count("*").alias("n_groups"))


@query("SELECT caption, count(*) AS n, min(pair_no) AS first_no, count(DISTINCT split) AS n_splits FROM pairs WHERE caption IS NOT NULL GROUP BY caption HAVING count(*) > 1")
def dup_groups(spark, sf):
    """AGG-12, AGG-05, GAT-02: repeated texts with their first row."""
    return read_table(spark, sf, "pairs").where("caption is not null").groupBy("caption").agg(F.count("*").alias("n"), F.min("pair_no").alias("first_no"), F.countDistinct("split").alias("n_splits")).where("n > 1")


@query("SELECT dataset, arg_min(split, struct_pack(a := -n, b := split)) AS common_split, max(n) AS n FROM (SELECT dataset, split, count(*) AS n FROM pairs WHERE split IS NOT NULL GROUP BY ALL) GROUP BY dataset")
def mode_split(spark, sf):
    """AGG-21: mode with a deterministic tie-break."""
    n = read_table(spark, sf, "pairs").where("split is not null").groupBy("dataset", "split").agg(F.count("*").alias("n"))
    return n.groupBy("dataset").agg(F.min_by("split", F.struct((-F.col("n")).alias("a"), "split")).alias("common_split"), F.max("n").alias("n"))


@query(f"""{_S}, c AS (SELECT component, split_part(sample_id, ':', 1) AS src, seed, avg(margin) AS m FROM scores GROUP BY ALL)
SELECT component, src, round(max(m) - min(m), 6) AS spread, count(*) AS n FROM c GROUP BY CUBE (component, src)""")
def slice_spread(spark, sf):
    """AGG-23, AGG-11: two-level aggregate over a cube, spread of seeds."""
    c = B.scores(spark, sf).groupBy("component", F.split_part("sample_id", F.lit(":"), F.lit(1)).alias("src"), "seed").agg(F.avg("margin").alias("m"))
    return c.cube("component", "src").agg(rounded(F.max("m") - F.min("m"), 6).alias("spread"), F.count("*").alias("n"))


@query("SELECT split_part(item_id, '|', 1) AS prefix, sum(length(caption_correct))::BIGINT AS total FROM probe1_items GROUP BY 1 ORDER BY total DESC, prefix LIMIT 12")
def prefix_sums(spark, sf):
    """AGG-32, SRT-05: sums by key prefix, largest first."""
    return read_table(spark, sf, "probe1_items").groupBy(F.substring_index("item_id", "|", 1).alias("prefix")).agg(F.sum(F.length("caption_correct")).cast("long").alias("total")).orderBy(F.desc("total"), "prefix").limit(12)


@query(f"""{_S}, o AS (SELECT seed, component, avg(correct::INT) AS acc FROM scores GROUP BY ALL) SELECT cell, count(*) AS n, round(avg(acc), 6) AS acc FROM (SELECT unnest(list_filter(['overall', CASE WHEN component LIKE 'C4%' THEN 'texture' END, CASE WHEN acc > 0.5 THEN 'above half' END], lambda x: x IS NOT NULL)) AS cell, acc FROM o) GROUP BY cell""")
def overlapping_cells(spark, sf):
    """FLT-10, FLT-02: rows counted in every cell they belong to."""
    o = B.scores(spark, sf).groupBy("seed", "component").agg(F.avg(F.col("correct").cast("int")).alias("acc"))
    cells = F.array_compact(F.array(F.lit("overall"), F.when(F.startswith("component", F.lit("C4")), "texture"), F.when(F.col("acc") > 0.5, "above half")))
    return o.select(F.explode(cells).alias("cell"), "acc").groupBy("cell").agg(F.count("*").alias("n"), rounded(F.avg("acc"), 6).alias("acc"))


_SETS = "a AS (SELECT DISTINCT sample_id FROM probe1_items), b AS (SELECT DISTINCT sample_id FROM manual_validation_sample)"


@query(f"WITH {_SETS} SELECT 'left only' AS part, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right only', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def set_symdiff(spark, sf):
    """SET-01 to SET-05."""
    a, b = read_table(spark, sf, "probe1_items").select("sample_id").distinct(), read_table(spark, sf, "manual_validation_sample").select("sample_id").distinct()
    n = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return n(a.subtract(b), "left only").unionAll(n(b.subtract(a), "right only")).unionAll(n(a.intersect(b), "both")).unionAll(n(a.union(b).distinct(), "either"))


@query("""WITH v AS (SELECT idx, lower(trim(q1_grammatical, ' ')) AS q1, lower(trim(q2_asserts_swap_to, ' ')) AS q2, lower(trim(q3_not_still_true, ' ')) AS q3 FROM manual_validation_sample), d AS (SELECT idx FROM v WHERE q1 = 'n' UNION SELECT idx FROM v WHERE q3 = 'n')
SELECT v.idx, d.idx IS NOT NULL AS defect, coalesce(q1 <> q3, false) AS disagree, coalesce(q1 IN ('y', 'n') AND q2 IN ('y', 'n') AND q3 IN ('y', 'n'), false) AS judged FROM v LEFT JOIN d USING (idx)""")
def defect_union(spark, sf):
    """SET-07: defects of two judging passes united, disagreements and blanks flagged."""
    tidy = lambda c: F.lower(F.trim(c))
    v = read_table(spark, sf, "manual_validation_sample").select("idx", tidy("q1_grammatical").alias("q1"), tidy("q2_asserts_swap_to").alias("q2"), tidy("q3_not_still_true").alias("q3"))
    d = v.where("q1 = 'n'").select("idx").union(v.where("q3 = 'n'").select("idx")).distinct().withColumn("hit", F.lit(True))
    judged = F.col("q1").isin("y", "n") & F.col("q2").isin("y", "n") & F.col("q3").isin("y", "n")
    return v.join(d, "idx", "left").select("idx", F.coalesce("hit", F.lit(False)).alias("defect"), F.coalesce(F.expr("q1 <> q3"), F.lit(False)).alias("disagree"), F.coalesce(judged, F.lit(False)).alias("judged"))


@query("""SELECT 'rows' AS gate, count(*) = max(pair_no) - min(pair_no) + 1 AS ok, false AS hard, count(*)::VARCHAR AS observed, (max(pair_no) - min(pair_no) + 1)::VARCHAR AS expected FROM pairs
UNION ALL SELECT 'pair_no unique', count(*) = 0, true, count(*)::VARCHAR, '0' FROM (SELECT pair_no FROM pairs GROUP BY pair_no HAVING count(*) > 1)
UNION ALL SELECT 'margin range', count(*) FILTER (NOT margin BETWEEN -2 AND 2) = 0, true, count(*) FILTER (NOT margin BETWEEN -2 AND 2)::VARCHAR, '0' FROM item_scores WHERE margin::VARCHAR <> 'nan'
UNION ALL SELECT 'probe samples known', count(*) = 0, false, count(*)::VARCHAR, '0' FROM (SELECT DISTINCT sample_id FROM probe1_items EXCEPT SELECT DISTINCT sample_id FROM pairs)""")
def gate_report(spark, sf):
    """GAT-01, GAT-02, GAT-07, GAT-12, GAT-13: gates as rows, hard and report-only."""
    pairs, items = read_table(spark, sf, "pairs"), read_table(spark, sf, "probe1_items")
    unknown = items.select("sample_id").distinct().subtract(pairs.select("sample_id").distinct())
    return G.report(
        [
            G.gate(pairs, "rows", F.count("*"), F.max("pair_no") - F.min("pair_no") + 1, hard=False),
            G.expect_unique(pairs, "pair_no unique", ["pair_no"]),
            G.expect_range(read_table(spark, sf, "item_scores").where("not isnan(margin)"), "margin range", "margin", -2, 2),
            G.gate(unknown, "probe samples known", F.count("*"), F.lit(0), hard=False),
        ]
    )


_COND = {
    "unperturbed": "e", "ex_half": B.HALF_SQL, "reverse": "list_reverse(e)",
    "masking": "list_transform(e, lambda v, i: CASE WHEN i % 5 = 0 THEN 0.0::DOUBLE ELSE v END)",
}
_LADDER = f"""WITH {_E}, q AS ({' UNION ALL '.join(f"SELECT vec_id AS id, label, '{c}' AS condition, {x} AS qv, list_dot_product({x}, e) AS sg FROM emb" for c, x in _COND.items())}),
r AS (SELECT q.condition, q.id, 1 + count(*) FILTER (list_dot_product(qv, e) > sg + 1e-9 AND vec_id <> id) + count(*) FILTER (abs(list_dot_product(qv, e) - sg) <= 1e-9 AND vec_id <> id) / 2.0::DOUBLE AS rank FROM q, emb GROUP BY q.condition, q.id)"""


def ladder(spark, sf):
    """Average rank of every vector's copy under each condition of the ladder."""
    v = B.vectors(spark, sf)
    x = F.col("vec")
    made = F.map_from_arrays(
        F.array(*map(F.lit, _COND)),
        F.array(x, A.swap_halves(x), F.reverse(x), F.transform(x, lambda t, i: F.when((i + 1) % 5 == 0, 0.0).otherwise(t))),
    )
    jobs = v.select("id", F.explode(made).alias("condition", "vec"))
    jobs = jobs.select(F.concat_ws("|", "condition", "id").alias("id"), F.col("id").cast("string").alias("gt"), "vec")
    ranked = R.rank_against_pool(jobs, v.select(F.col("id").cast("string").alias("id"), "vec"))
    return ranked.select(F.split_part("query_id", F.lit("|"), F.lit(1)).alias("condition"), F.split_part("query_id", F.lit("|"), F.lit(2)).cast("long").alias("id"), R.average_rank().alias("rank"))


@query(f"""{_LADDER}, b AS (SELECT avg(1 / rank) AS m FROM r WHERE condition = 'unperturbed'), u AS (SELECT id, rank AS r0 FROM r WHERE condition = 'unperturbed')
SELECT condition, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(1 - avg(1 / rank) / any_value(b.m), 6) AS degradation, round(avg(r0 / rank), 6) AS retention, round(avg(ln(rank / r0)), 6) AS log_ratio, round(any_value(b.m) - avg(1 / rank), 6) AS delta FROM r JOIN u USING (id), b GROUP BY condition""")
def degradation_profile(spark, sf):
    """MTH-04, MTH-05, MTH-06, ARR-20, AGG-29: metrics of each condition against the unperturbed one."""
    r = ladder(spark, sf)
    base = F.max(F.when(F.col("condition") == "unperturbed", F.col("rank"))).over(W.partitionBy("id"))
    r = r.withColumn("r0", base)
    m0 = F.avg(1 / F.col("r0"))
    mrr = F.avg(1 / F.col("rank"))
    return r.groupBy("condition").agg(
        F.count("*").alias("n"), rounded(mrr, 6).alias("mrr"), rounded(1 - mrr / m0, 6).alias("degradation"), rounded(F.avg(F.col("r0") / F.col("rank")), 6).alias("retention"),
        rounded(F.avg(F.ln(F.col("rank") / F.col("r0"))), 6).alias("log_ratio"), rounded(m0 - mrr, 6).alias("delta"),
    )


@query(f"""WITH {_E}, s AS (SELECT a.label, a.vec_id, list_dot_product(a.e, b.e) AS s FROM emb a JOIN emb b ON a.vec_id // 128 = b.vec_id // 128),
m AS (SELECT label, vec_id, max(s) AS top FROM s GROUP BY ALL), x AS (SELECT s.label, s.vec_id, sum(exp(s - top)) AS z, any_value(top) AS top FROM s JOIN m USING (vec_id, label) GROUP BY ALL)
SELECT label, round(avg(ln(z) + top), 6) AS logsumexp FROM x GROUP BY label""")
def in_batch_softmax(spark, sf):
    """MTH-12: log-sum-exp over in-batch scores; a batch is 128 consecutive ids, scored as one matrix product."""
    v = B.vectors(spark, sf).select("id", "vec", "label")
    batches = v.groupBy(F.floor(F.col("id") / 128).alias("batch")).agg(F.collect_list(F.struct("label", "vec")).alias("rows"))  # 128 at most
    z = batches.select("rows").mapInArrow(R.batch_logsumexp, "label int, lse double")
    return z.groupBy("label").agg(rounded(F.avg("lse"), 6).alias("logsumexp"))


@query("SELECT component, count(*) AS n, sum(greatest(1, length(caption_correct) // 4))::BIGINT AS tokens, round(sum(greatest(1, length(caption_correct) // 4)) * 0.13 / 1000000, 9) AS cost, sum(greatest(1, length(caption_correct) // 4)) BETWEEN 1 AND 1000000 AS in_budget FROM probe1_items GROUP BY component")
def cost_estimate(spark, sf):
    """MTH-16, GAT-14: token cost and budget band."""
    tokens = F.sum(F.greatest(F.lit(1), F.floor(F.length("caption_correct") / 4))).cast("long")
    return read_table(spark, sf, "probe1_items").groupBy("component").agg(F.count("*").alias("n"), tokens.alias("tokens"), F.round(tokens * 0.13 / 1000000, 9).alias("cost"), tokens.between(1, 1000000).alias("in_budget"))


@query("SELECT event_id, user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events QUALIFY nth = 1 OR nth = count(*) OVER (PARTITION BY user_id) OR nth = count(*) OVER (PARTITION BY user_id) // 2 + 1")
def worked_examples(spark, sf):
    """SRT-08: first, middle and last event of each user."""
    w = W.partitionBy("user_id")
    e = read_table(spark, sf, "events").withColumn("nth", F.row_number().over(w.orderBy("ts", "event_id")).cast("long")).withColumn("k", F.count("*").over(w))
    return e.where("nth = 1 or nth = k or nth = k div 2 + 1").select("event_id", "user_id", "value", "ts", "nth")
