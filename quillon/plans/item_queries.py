"""Item generation, sampling and splits over pairs, items and component pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.functions.numbers import rounded
from quillon.operators import gates as G
from quillon.operators import items as I
from quillon.operators import sampling as S
from quillon.plans import base as B
from quillon.plans.registry import query
from quillon.plans.text_queries import _SENT, _score_sql
from quillon.session import read_table, stage

_LAB = "trim(lower(split_part(class_label, ';', {0})), ' ')"
_POOLS = f"""lab AS (SELECT pair_no, sample_id, {_LAB.format(1)} AS fluct, {_LAB.format(2)} AS shape, {_SENT.format('caption')} AS s FROM pairs WHERE caption IS NOT NULL AND class_label IS NOT NULL),
pools AS (SELECT DISTINCT 'fluct' AS slot, fluct AS value, s[len(s)] AS clause FROM lab WHERE len(s) >= 2 AND fluct <> 'clean' UNION SELECT DISTINCT 'shape', shape, s[1] FROM lab WHERE len(s) >= 2)"""


def labelled(spark, sf):
    part = lambda k: F.trim(F.lower(F.split_part("class_label", F.lit(";"), F.lit(k))))
    rows = read_table(spark, sf, "pairs").where("caption is not null and class_label is not null")
    return rows.select("pair_no", "sample_id", part(1).alias("fluct"), part(2).alias("shape"), T.sentences(F.col("caption")).alias("s"))


def pools(spark, sf):
    lab = labelled(spark, sf).where("size(s) >= 2")
    fluct = lab.where("fluct <> 'clean'").select(F.lit("fluct").alias("slot"), F.col("fluct").alias("value"), F.element_at("s", -1).alias("clause"))
    shape = lab.select(F.lit("shape").alias("slot"), F.col("shape").alias("value"), F.element_at("s", 1).alias("clause"))
    return I.clause_pools(fluct.unionByName(shape))


@query(f"WITH {_POOLS} SELECT slot, value, count(*) AS n, min(clause) AS first_clause FROM pools GROUP BY slot, value")
def clause_pools(spark, sf):
    """ITM-01, AGG-10, MAP-02: clause pools per slot and value."""
    return pools(spark, sf).groupBy("slot", "value").agg(F.count("*").alias("n"), F.min("clause").alias("first_clause"))


def generated(spark, sf):
    """Swap items: both directions, five items per direction, a clause of the target put in for the caption's last
    sentence (fluctuation) or its first (shape)."""
    dirs = I.both_directions(read_table(spark, sf, "component_pairs"))
    parts = F.array(
        F.struct(F.lit("fluct").alias("slot"), F.col("fluct").alias("source"), F.element_at("s", -1).alias("clause")),
        F.struct(F.lit("shape").alias("slot"), F.col("shape").alias("source"), F.element_at("s", 1).alias("clause")),
    )
    it = labelled(spark, sf).where("size(s) >= 2").select("pair_no", "s", F.inline(parts)).join(F.broadcast(dirs), ["slot", "source"])
    it = it.select(F.concat_ws("|", "component", "pair_no", "target").alias("item_key"), "component", "slot", "source", "target", "s", "clause")
    it = S.sample_per_group(it, ["component", "source", "target"], "item_key", 5).drop("pick")
    chosen = I.closest_clause(it, pools(spark, sf))
    new, others = F.array("new_clause"), F.size("s") - 1
    swapped = F.when(F.col("slot") == "shape", F.concat(new, F.slice("s", F.lit(2), others))).otherwise(F.concat(F.slice("s", F.lit(1), others), new))
    return it.join(chosen, "item_key").withColumn("swapped", swapped).withColumns({"distractor": F.array_join("swapped", " "), "correct": F.array_join("s", " ")})


def validated(items):
    differing = F.size(F.filter(F.zip_with("s", "swapped", lambda a, b: a != b), lambda x: x))
    return items.groupBy("component").agg(
        F.count("*").alias("n"), F.count_if(F.col("correct") == F.col("distractor")).alias("n_identical"), F.count_if(F.size(T.sentences(F.col("distractor"))) != F.size("s")).alias("n_other_length"), F.count_if(differing == 1).alias("n_one_clause")
    )


_ITEMS = f"""{_POOLS}, dirs AS (SELECT component, slot, value_a AS source, value_b AS target FROM component_pairs UNION ALL SELECT component, slot, value_b, value_a FROM component_pairs),
it0 AS (SELECT component || '|' || pair_no || '|' || target AS item_key, component, d.slot, source, target, s, CASE d.slot WHEN 'shape' THEN s[1] ELSE s[len(s)] END AS clause
  FROM lab JOIN dirs d ON CASE d.slot WHEN 'shape' THEN lab.shape ELSE lab.fluct END = d.source WHERE len(s) >= 2),
it AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY component, source, target ORDER BY md5('42|' || item_key), item_key) AS pick FROM it0) WHERE pick <= 5),
c AS (SELECT item_key, p.clause AS new_clause, row_number() OVER (PARTITION BY item_key ORDER BY abs(length(p.clause) - length(it.clause)), p.clause) AS near FROM it JOIN pools p ON p.slot = it.slot AND p.value = it.target),
ch AS (SELECT item_key, arg_min(new_clause, md5('42|' || item_key || '|' || near)) AS new_clause FROM c WHERE near <= 3 GROUP BY item_key),
gen AS (SELECT it.*, new_clause, CASE it.slot WHEN 'shape' THEN list_concat([new_clause], s[2:]) ELSE list_concat(s[1:len(s) - 1], [new_clause]) END AS swapped, array_to_string(swapped, ' ') AS distractor, array_to_string(s, ' ') AS correct FROM it JOIN ch USING (item_key))"""


@query(f"WITH {_ITEMS} SELECT item_key, component, slot, source, target, new_clause, distractor FROM gen")
def swap_items(spark, sf):
    """ITM-02, ITM-03, WIN-14, JON-11: clause substitution in both slots with quota and hash pick."""
    return generated(spark, sf).select("item_key", "component", "slot", "source", "target", "new_clause", "distractor")


@query(f"""WITH {_ITEMS} SELECT component, count(*) AS n, count(*) FILTER (correct = distractor) AS n_identical, count(*) FILTER (len({_SENT.format('distractor')}) <> len(s)) AS n_other_length,
  count(*) FILTER (list_sum(list_transform(range(1, len(s) + 1), lambda i: (s[i] <> swapped[i])::INT)) = 1) AS n_one_clause FROM gen GROUP BY component""")
def item_validate(spark, sf):
    """ITM-04: no identity, same sentence count, exactly one differing clause, over the items of both slots."""
    return validated(generated(spark, sf))


@query("""WITH i AS (SELECT item_id, swap_from AS a, component AS b FROM probe1_items WHERE swap_from IS NOT NULL), c AS (SELECT a, b, list(item_id ORDER BY md5('42|' || item_id), item_id)[1:20] AS pool FROM i GROUP BY a, b),
p AS (SELECT l.a AS a1, l.b AS b1, r.pool, (r.b <> l.b)::INT AS strict, row_number() OVER (PARTITION BY l.a, l.b ORDER BY (r.b <> l.b)::INT DESC, md5('42|' || l.a || '|' || l.b || '|' || r.a || '|' || r.b), r.a, r.b) AS nth FROM c l JOIN c r ON l.a <> r.a)
SELECT item_id, pool[('0x' || sha256(item_id)[1:8])::BIGINT % len(pool) + 1] AS partner, strict FROM i JOIN p ON i.a = p.a1 AND i.b = p.b1 WHERE nth = 1""")
def random_control(spark, sf):
    """JON-11, ITM-03, FLT-05: a partner drawn for every item, differing in both attributes, relaxed where there is none."""
    i = read_table(spark, sf, "probe1_items").where("swap_from is not null").select("item_id", F.col("swap_from").alias("a"), F.col("component").alias("b"))
    return I.random_partner(i, "item_id", "a", "b")


_TEMPLATE = "Which text fits? A: {option_a} B: {option_b}"


@query(f"""WITH i AS (SELECT item_id, caption_correct AS c, caption_distractor AS d, unnest(['corrA', 'corrB']) AS answer_order FROM probe1_items WHERE caption_distractor IS NOT NULL)
SELECT item_id || '|' || answer_order AS mcq_id, CASE answer_order WHEN 'corrA' THEN 'A' ELSE 'B' END AS correct_letter, 'Which text fits? A: ' || CASE answer_order WHEN 'corrA' THEN c ELSE d END || ' B: ' || CASE answer_order WHEN 'corrA' THEN d ELSE c END AS prompt,
  sha256('{_TEMPLATE}')[1:12] AS template_sha FROM i""")
def mcq_manifest(spark, sf):
    """PRJ-09, PRJ-10, ITM-06, GAT-11: both answer orders with rendered prompts."""
    i = read_table(spark, sf, "probe1_items").where("caption_distractor is not null").select("item_id", "caption_correct", "caption_distractor")
    m = I.answer_orders(i, "caption_correct", "caption_distractor", _TEMPLATE)
    return m.select(F.concat_ws("|", "item_id", "answer_order").alias("mcq_id"), "correct_letter", "prompt", "template_sha")


@query(f"""WITH {B.POOL_SQL}, ix AS (SELECT sample_id AS id, row_number() OVER (ORDER BY sample_id) - 1 AS idx, count(*) OVER () AS n FROM pool), j AS (SELECT id, ('0x' || sha256(id)[1:8])::BIGINT % n AS i, n FROM ix)
SELECT j.id, CASE WHEN a.id = j.id THEN b.id ELSE a.id END AS donor FROM j JOIN ix a ON a.idx = j.i JOIN ix b ON b.idx = (j.i + 1) % j.n""")
def donors(spark, sf):
    """JON-12: cyclic donor that is never the row itself."""
    p = B.pool(spark, sf).select(F.col("sample_id").alias("id"))
    # contiguous numbers without one global window: ranks within hash-free ranges plus offsets of the ranges
    ranged = p.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "ranged")  # the ranges are read twice and must not be cut again
    sizes = ranged.groupBy("part").agg(F.count("*").alias("k"))
    offsets = sizes.withColumn("before", F.sum("k").over(W.orderBy("part")) - F.col("k")).select("part", "before")  # one row per partition
    idx = (F.row_number().over(W.partitionBy("part").orderBy("id")) - 1 + F.col("before")).cast("long")
    indexed = ranged.join(F.broadcast(offsets), "part").select("id", idx.alias("idx"))
    return I.next_not_self(p, indexed, "id")


@query("""WITH p AS (SELECT pair_no, coalesce(class_label, dataset) AS stratum FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || pair_no), pair_no) AS nth, count(*) OVER (PARTITION BY stratum) AS n FROM p)
SELECT pair_no, CASE WHEN n < 3 THEN 'train' WHEN nth <= greatest(1, n // 10) THEN 'test' WHEN nth <= 2 * greatest(1, n // 10) THEN 'val' ELSE 'train' END AS new_split FROM r""")
def stratified_split(spark, sf):
    """WIN-15: 8:1:1 per class with at least one row in val and test."""
    p = read_table(spark, sf, "pairs").select("pair_no", F.coalesce("class_label", "dataset").alias("stratum"))
    return S.stratified_split(p, ["stratum"], "pair_no").select("pair_no", "new_split")


@query("""SELECT item_id, component, pick FROM (SELECT item_id, component, row_number() OVER (PARTITION BY component, probe_condition ORDER BY md5('42|' || item_id), item_id) AS pick FROM probe1_items) WHERE pick <= 3""")
def sample_per_component(spark, sf):
    """SMP-01, SMP-03, SMP-05, SRT-06: seeded sample without replacement, all of a small group."""
    s = S.sample_per_group(read_table(spark, sf, "probe1_items"), ["component", "probe_condition"], "item_id", 3)
    return s.select("item_id", "component", F.col("pick").cast("long").alias("pick"))


@query("""WITH q AS (SELECT component, count(*) // 4 + 1 AS quota FROM probe1_items GROUP BY component), r AS (SELECT item_id, component, row_number() OVER (PARTITION BY component ORDER BY md5('42|' || item_id), item_id) AS pick FROM probe1_items)
SELECT item_id, component FROM r JOIN q USING (component) WHERE pick <= quota""")
def quota_sample(spark, sf):
    """SMP-02: quota table joined, then sampled."""
    i = read_table(spark, sf, "probe1_items").select("item_id", "component")
    quota = i.groupBy("component").agg((F.floor(F.count("*") / 4) + 1).alias("quota"))
    return S.sample_per_group(i.join(quota, "component"), ["component"], "item_id", "quota").select("item_id", "component")


@query("""WITH r AS (SELECT item_id, component, (row_number() OVER (PARTITION BY component ORDER BY md5('42|' || item_id), item_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY component) AS position FROM probe1_items),
o AS (SELECT *, row_number() OVER (ORDER BY position, component, item_id) AS i FROM r)
SELECT item_id, round(position, 6) AS position, i AS reading_order, (i - 1) // 100 + 1 AS batch FROM o""")
def interleave_prefix(spark, sf):
    """WIN-16, WIN-17, SMP-04, SRT-04: reading order of a judgment sheet whose every prefix is stratified."""
    r = S.interleave(read_table(spark, sf, "probe1_items").select("item_id", "component"), ["component"], "item_id")
    o = r.withColumn("i", F.row_number().over(W.orderBy("position", "component", "item_id")).cast("long"))  # a sheet for people
    return o.select("item_id", rounded("position", 6).alias("position"), F.col("i").alias("reading_order"), (F.floor((F.col("i") - 1) / 100) + 1).alias("batch"))


_BAD = "md5('bad|' || item_id) < '2'"


@query(f"""WITH i AS (SELECT item_id, regexp_replace(item_id, '\\|[^|]*$', '') AS pair_key FROM probe1_items), bad AS (SELECT item_id FROM i WHERE {_BAD})
SELECT item_id, pair_key FROM i WHERE pair_key NOT IN (SELECT pair_key FROM i WHERE item_id IN (SELECT item_id FROM bad))""")
def excise_twins(spark, sf):
    """ITM-07, JON-13, PRJ-03, SNK-07: defective items and their twins removed."""
    i = read_table(spark, sf, "probe1_items").select("item_id", I.drop_last_field(F.col("item_id")).alias("pair_key"))
    bad = i.where(F.md5(F.concat(F.lit("bad|"), "item_id")) < "2").select("item_id")
    return I.excise(i, bad, "item_id", "pair_key").select("item_id", "pair_key")


@query("""WITH v AS (SELECT sample_id, lower(trim(q1_grammatical, ' ')) AS q1, lower(trim(q3_not_still_true, ' ')) AS q3 FROM manual_validation_sample WHERE sample_id IS NOT NULL),
m AS (SELECT sample_id, CASE WHEN bool_and(q1 = 'y' AND q3 = 'y') THEN 'certified_ok' ELSE 'certified_bad' END AS new_label FROM v WHERE q1 IN ('y', 'n') AND q3 IN ('y', 'n') GROUP BY sample_id)
SELECT item_id, coalesce(new_label, 'rule_' || probe_condition) AS label, CASE WHEN new_label IS NULL THEN 'rule' ELSE 'certified' END AS provenance FROM probe1_items LEFT JOIN m USING (sample_id)""")
def label_override(spark, sf):
    """ITM-08, JON-18, PRJ-16: human verdicts over rule labels, with provenance."""
    tidy = lambda c: F.lower(F.trim(c))
    v = read_table(spark, sf, "manual_validation_sample").where("sample_id is not null").select("sample_id", tidy("q1_grammatical").alias("q1"), tidy("q3_not_still_true").alias("q3"))
    v = v.where(F.col("q1").isin("y", "n") & F.col("q3").isin("y", "n"))
    moves = v.groupBy("sample_id").agg(F.when(F.bool_and((F.col("q1") == "y") & (F.col("q3") == "y")), "certified_ok").otherwise("certified_bad").alias("new_label"))
    base = read_table(spark, sf, "probe1_items").select("item_id", "sample_id", F.concat(F.lit("rule_"), "probe_condition").alias("label"))
    return I.override(base, moves, "sample_id", "label").select("item_id", "label", "provenance")


@query(f"""WITH l AS (SELECT DISTINCT {_LAB.format(1)} AS f, {_LAB.format(2)} AS s FROM pairs WHERE class_label IS NOT NULL)
SELECT a.f, b.s FROM (SELECT DISTINCT f FROM l) a, (SELECT DISTINCT s FROM l) b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.f = a.f AND l.s = b.s)""")
def grammar_completeness(spark, sf):
    """JON-15, TXT-06: label combinations the product of the slots has but the data has not."""
    part = lambda k: F.trim(F.lower(F.split_part("class_label", F.lit(";"), F.lit(k))))
    seen = read_table(spark, sf, "pairs").where("class_label is not null").select(part(1).alias("f"), part(2).alias("s")).distinct()
    return seen.select("f").distinct().crossJoin(seen.select("s").distinct()).join(seen, ["f", "s"], "left_anti")  # two slot vocabularies


@query(f"""WITH {_POOLS}, e AS (SELECT clause, count(DISTINCT value) FILTER (slot = 'shape') AS n_shape, count(DISTINCT value) FILTER (slot = 'fluct') AS n_fluct FROM pools GROUP BY clause)
SELECT CASE WHEN n_shape + n_fluct = 1 THEN 'exclusive' ELSE 'ambiguous' END AS kind, count(*) AS n_clauses, max(n_shape + n_fluct) AS most FROM e GROUP BY 1""")
def clause_exclusivity(spark, sf):
    """MAP-05, TXT-06, AGG-13: clauses used by one slot value only."""
    p = pools(spark, sf)
    n = lambda slot: F.size(F.collect_set(F.when(F.col("slot") == slot, F.col("value"))))
    e = p.groupBy("clause").agg((n("shape") + n("fluct")).cast("long").alias("n"))
    return e.groupBy(F.when(F.col("n") == 1, "exclusive").otherwise("ambiguous").alias("kind")).agg(F.count("*").alias("n_clauses"), F.max("n").alias("most"))


_NET = f"({_score_sql(V.UP_STEMS)}) - ({_score_sql(V.DOWN_STEMS)})".replace("caption", "s[1]")
_VALUES = f"""{_POOLS}, sc AS (SELECT shape AS v, sum({_NET}) AS net FROM lab WHERE len(s) >= 2 GROUP BY shape),
d AS (SELECT v, slot, coalesce(sign(net), 0) AS dir FROM (SELECT value_a AS v, slot FROM component_pairs UNION SELECT value_b, slot FROM component_pairs) LEFT JOIN sc USING (v)),
pr AS (SELECT a.slot, a.v AS a, b.v AS b, CASE WHEN a.slot <> 'shape' THEN 'any' WHEN a.dir * b.dir < 0 THEN 'opposite' WHEN a.dir * b.dir > 0 THEN 'same direction' ELSE 'cross' END AS kind FROM d a JOIN d b ON a.slot = b.slot AND a.v < b.v)"""


def value_pairs(spark, sf):
    """(slot, a, b, kind): all pairs of a slot's values. Shapes are compared by the net number of rising stems in the clauses
    that describe them, over all labelled captions."""
    cp = read_table(spark, sf, "component_pairs")
    net = labelled(spark, sf).where("size(s) >= 2").groupBy(F.col("shape").alias("v")).agg(F.sum(T.stem_score(F.element_at("s", 1))).alias("net"))
    v = cp.select(F.explode(F.array("value_a", "value_b")).alias("v"), "slot").distinct()
    d = v.join(net, "v", "left").select("slot", "v", F.signum(F.coalesce("net", F.lit(0))).alias("dir"))
    pairs = d.select("slot", F.col("v").alias("a"), F.col("dir").alias("da")).join(d.select("slot", F.col("v").alias("b"), F.col("dir").alias("db")), "slot").where("a < b")
    both = F.col("da") * F.col("db")
    kind = F.when(F.col("slot") != "shape", "any").when(both < 0, "opposite").when(both > 0, "same direction").otherwise("cross")
    return pairs.select("slot", "a", "b", kind.alias("kind"))


def listed_pairs(spark, sf):
    return read_table(spark, sf, "component_pairs").select("slot", F.least("value_a", "value_b").alias("a"), F.greatest("value_a", "value_b").alias("b"), "component")


@query(f"""WITH {_VALUES} SELECT pr.slot, kind, count(*) AS n_pairs, count(c.component) AS n_listed FROM pr
  LEFT JOIN component_pairs c ON c.slot = pr.slot AND least(c.value_a, c.value_b) = pr.a AND greatest(c.value_a, c.value_b) = pr.b GROUP BY ALL""")
def component_table(spark, sf):
    """TXT-07, JON-07: value pairs of a slot by the direction their captions tell, and how many the component table lists."""
    pairs = value_pairs(spark, sf).join(listed_pairs(spark, sf), ["slot", "a", "b"], "left")
    return pairs.groupBy("slot", "kind").agg(F.count("*").alias("n_pairs"), F.count("component").alias("n_listed"))


@query(f"""WITH {_VALUES}, t AS (SELECT slot, clause FROM pools GROUP BY slot, clause HAVING count(DISTINCT value) > 1)
SELECT 'clauses of one value' AS gate, count(*) = 0 AS ok, false AS hard, count(*)::VARCHAR AS observed, '0' AS expected FROM t
UNION ALL SELECT 'fluctuation told', count(*) = 0, false, count(*)::VARCHAR, '0' FROM lab WHERE fluct <> 'clean' AND len(s) < 2
UNION ALL SELECT 'trend pairs point apart', count(*) = 0, false, count(*)::VARCHAR, '0' FROM pr JOIN component_pairs c ON c.slot = pr.slot AND least(c.value_a, c.value_b) = pr.a AND greatest(c.value_a, c.value_b) = pr.b
  WHERE component = 'C1_trend_direction' AND kind <> 'opposite'""")
def component_gates(spark, sf):
    """TXT-07, GAT-12: the table's three gates: every clause belongs to one value, every fluctuation is told by a clause of
    its own, and the trend pairs point in opposite directions."""
    tied = pools(spark, sf).groupBy("slot", "clause").agg(F.countDistinct("value").alias("k")).where("k > 1")
    untold = labelled(spark, sf).where("fluct <> 'clean' and size(s) < 2")
    trend = value_pairs(spark, sf).join(listed_pairs(spark, sf).where("component = 'C1_trend_direction'"), ["slot", "a", "b"]).where("kind <> 'opposite'")
    gates = {"clauses of one value": tied, "fluctuation told": untold, "trend pairs point apart": trend}
    return G.report([G.gate(df, name, F.count("*"), F.lit(0), hard=False) for name, df in gates.items()])


@query("""WITH i AS (SELECT item_id, component, CASE WHEN caption_distractor IS NULL THEN 'no distractor' WHEN probe_condition = 'swap' AND clause_replaced_to IS NULL THEN 'no clause' WHEN caption_correct = caption_distractor THEN 'identical'
  WHEN probe_condition = 'swap' AND NOT contains(caption_correct, clause_replaced_from) THEN 'clause not found' END AS skip FROM probe1_items)
SELECT component, coalesce(skip, 'kept') AS reason, count(*) AS n FROM i GROUP BY ALL""")
def skip_reasons(spark, sf):
    """ITM-05: candidates by skip reason."""
    i = read_table(spark, sf, "probe1_items")
    swap = F.col("probe_condition") == "swap"
    skip = (
        F.when(F.col("caption_distractor").isNull(), "no distractor").when(swap & F.col("clause_replaced_to").isNull(), "no clause").when(F.col("caption_correct") == F.col("caption_distractor"), "identical")
        .when(swap & ~F.contains("caption_correct", "clause_replaced_from"), "clause not found")
    )
    return i.groupBy("component", F.coalesce(skip, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
