"""Retrieval: ranks of every vector's half-swapped copy against the whole pool, and metrics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import arrays as A
from quillon.functions.numbers import rounded
from quillon.operators import retrieval as R
from quillon.plans import base as B
from quillon.plans.registry import query

_E = "emb AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"
_SIM = f"""{_E}, q AS (SELECT vec_id AS query_id, label, {B.HALF_SQL} AS qv, list_dot_product({B.HALF_SQL}, e) AS sg FROM emb),
sim AS (SELECT q.query_id, q.label, emb.vec_id AS member_id, emb.label AS member_label, list_dot_product(q.qv, emb.e) AS s, q.sg FROM q, emb)"""
_COUNTS = f"""{_SIM}, cnt AS (SELECT query_id, label,
  count(*) FILTER (s > sg + 1e-9 AND member_id <> query_id) AS n_greater,
  count(*) FILTER (abs(s - sg) <= 1e-9 AND member_id <> query_id) AS n_equal,
  count(*) FILTER (abs(s - sg) <= 1e-9 AND member_id < query_id) AS n_before FROM sim GROUP BY query_id, label)"""
_METRICS = """count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS r_at_1, round(avg((rank <= 5)::INT), 6) AS r_at_5,
  round(avg((rank <= 10)::INT), 6) AS r_at_10, median(rank)::DOUBLE AS median_rank"""
_AVG = "1 + n_greater + n_equal / 2.0::DOUBLE"


def counts(spark: SparkSession, sf: str) -> DataFrame:
    queries = B.half_swapped(spark, sf)
    ranked = R.rank_against_pool(queries, B.vectors(spark, sf))
    return ranked.join(queries.select(F.col("id").alias("query_id"), "label"), "query_id")


@query(f"WITH {_COUNTS} SELECT query_id, {_AVG} AS avg_rank, n_equal FROM cnt")
def rank_average_ties(spark, sf):
    """WIN-03: average rank and tie count."""
    return counts(spark, sf).select("query_id", R.average_rank().alias("avg_rank"), "n_equal")


@query(f"WITH {_COUNTS} SELECT query_id, 1 + n_greater + n_before AS rank FROM cnt")
def rank_strict(spark, sf):
    """WIN-01: position in the descending order, ties by id."""
    return counts(spark, sf).select("query_id", R.positional_rank().alias("rank"))


@query(f"WITH {_COUNTS} SELECT query_id, 1 + n_greater AS rank FROM cnt")
def rank_competition(spark, sf):
    """WIN-02: 1 + members scoring strictly higher."""
    return counts(spark, sf).select("query_id", R.competition_rank().alias("rank"))


@query(f"WITH {_COUNTS}, r AS (SELECT label, {_AVG} AS rank FROM cnt) SELECT label, {_METRICS} FROM r GROUP BY label")
def retrieval_exhalf_by_label(spark, sf):
    """AGG-28: n, MRR, recall and median rank per label."""
    return counts(spark, sf).withColumn("rank", R.average_rank()).groupBy("label").agg(*R.metrics())


@query(f"""WITH {_COUNTS}, r AS (SELECT label, {_AVG} AS rank FROM cnt)
SELECT coalesce(label::VARCHAR, 'all') AS cell, {_METRICS} FROM r GROUP BY GROUPING SETS ((label), ())""")
def retrieval_grouping_sets(spark, sf):
    """AGG-22: per label and pooled in one pass."""
    ranked = counts(spark, sf).withColumn("rank", R.average_rank())
    return ranked.rollup("label").agg(*R.metrics()).withColumn("cell", F.coalesce(F.col("label").cast("string"), F.lit("all"))).drop("label")


@query(f"WITH {_COUNTS} SELECT label, round(avg((n_greater = 0)::INT), 6) AS p_at_1 FROM cnt GROUP BY label")
def p_at_1_ties(spark, sf):
    """WIN-06: ties for the top count as correct."""
    return counts(spark, sf).groupBy("label").agg(rounded(F.avg((F.col("n_greater") == 0).cast("double")), 6).alias("p_at_1"))


@query(f"""WITH {_COUNTS}, back AS (SELECT member_id AS query_id,
    count(*) FILTER (s > own + 1e-9) + 1 AS back_rank FROM (SELECT member_id, query_id, s,
    max(s) FILTER (query_id = member_id) OVER (PARTITION BY member_id) AS own FROM sim) WHERE query_id <> member_id GROUP BY member_id)
SELECT query_id, 1 + n_greater AS forward_rank, back_rank FROM cnt JOIN back USING (query_id)""")
def rank_bidirectional(spark, sf):
    """WIN-05: both directions of one score matrix."""
    vec, half = B.vectors(spark, sf), B.half_swapped(spark, sf)
    forward = R.rank_against_pool(half, vec).select("query_id", R.competition_rank().alias("forward_rank"))
    back = R.rank_against_pool(vec.select("id", F.col("id").alias("gt"), "vec"), half.select("id", "vec"))
    return forward.join(back.select("query_id", R.competition_rank().alias("back_rank")), "query_id")


@query(f"""WITH {_E}, grp AS (SELECT vec_id, label, e, min(vec_id) OVER (PARTITION BY list_transform(e[1:6], lambda x: x > 0)) AS first_id FROM emb),
canon AS (SELECT g.vec_id AS vec_id, f.e AS e FROM grp g JOIN emb f ON f.vec_id = g.first_id),
q AS (SELECT emb.vec_id AS query_id, {B.HALF_SQL.replace('e[', 'emb.e[')} AS qv, list_dot_product({B.HALF_SQL.replace('e[', 'emb.e[')}, canon.e) AS sg FROM emb JOIN canon USING (vec_id))
SELECT query_id, 1 + count(*) FILTER (list_dot_product(qv, canon.e) > sg + 1e-9)
  + (count(*) FILTER (abs(list_dot_product(qv, canon.e) - sg) <= 1e-9) - 1) / 2.0::DOUBLE AS avg_rank FROM q, canon GROUP BY query_id""")
def rank_tie_canonical(spark, sf):
    """WIN-04: members with one content key take the first member's vector, then average ranks. The key is read off the
    content: the signs of the first six values, as distinct vectors are all the table has."""
    vec = B.vectors(spark, sf)
    content = F.transform(F.slice("vec", 1, 6), lambda x: x > 0)
    first = vec.groupBy(content.alias("content")).agg(F.min_by("vec", "id").alias("v"))
    canon = vec.select("id", content.alias("content")).join(first, "content").select("id", F.col("v").alias("vec"))
    return R.rank_against_pool(B.half_swapped(spark, sf), canon).select("query_id", R.average_rank().alias("avg_rank"))


_TOP = f"""{_SIM}, top AS (SELECT query_id, label, member_id, member_label, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, member_id) AS rank FROM sim)"""


@query(f"WITH {_TOP.replace('FROM sim)', 'FROM sim WHERE query_id <> member_id)')} SELECT query_id, member_id, rank, round(score, 6) AS score FROM top WHERE rank <= 5")
def topk_neighbours(spark, sf):
    """SRT-02: the five best members other than the query itself."""
    top = R.top_members(B.half_swapped(spark, sf), B.vectors(spark, sf), 5)
    return top.select("query_id", "member_id", F.col("rank").cast("long").alias("rank"), rounded("score", 6).alias("score"))


@query(f"""WITH {_TOP}, rel AS (SELECT query_id, rank, (label = member_label)::INT AS r FROM top WHERE rank <= 10),
cum AS (SELECT *, sum(r) OVER (PARTITION BY query_id ORDER BY rank) AS c FROM rel),
tot AS (SELECT vec_id AS query_id, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT query_id, round(sum(r * c / rank) / least(any_value(n), 10), 6) AS ap FROM cum JOIN tot USING (query_id) GROUP BY query_id""")
def map_at_10_label(spark, sf):
    """WIN-19: average precision at 10, relevant = same label."""
    vec = B.vectors(spark, sf)
    top = R.top_members(B.half_swapped(spark, sf), vec, 10, keep_self=True)
    label = vec.select(F.col("id").alias("query_id"), "label")
    member = vec.select(F.col("id").alias("member_id"), F.col("label").alias("member_label"))
    ranked = top.join(label, "query_id").join(member, "member_id").withColumn("rel", (F.col("label") == F.col("member_label")).cast("int"))
    relevant = label.join(label.groupBy("label").agg(F.count("*").alias("n_relevant")), "label").select("query_id", "n_relevant")
    return R.average_precision(ranked, relevant).select("query_id", rounded("ap", 6).alias("ap"))


@query(f"""WITH {_TOP.replace('FROM sim)', 'FROM sim WHERE query_id <> member_id)')}
SELECT query_id, rank, round(lag(score) OVER w - score, 6) AS above, round(score - lead(score) OVER w, 6) AS below FROM top WHERE rank <= 5
WINDOW w AS (PARTITION BY query_id ORDER BY rank)""")
def rank_margin_neighbours(spark, sf):
    """WIN-18: margins to the neighbours above and below in rank order."""
    w = W.partitionBy("query_id").orderBy("rank")
    top = R.top_members(B.half_swapped(spark, sf), B.vectors(spark, sf), 5)
    return top.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        rounded(F.lag("score").over(w) - F.col("score"), 6).alias("above"),
        rounded(F.col("score") - F.lead("score").over(w), 6).alias("below"),
    )


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, n, round(list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)) / n, 9) AS chance_mrr,
  round(1.0::DOUBLE / n, 9) AS chance_r_at_1, round(least(10, n)::DOUBLE / n, 9) AS chance_r_at_10 FROM n""")
def chance_reference(spark, sf):
    """AGG-26: chance level of a pool per label."""
    sizes = B.vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return sizes.select("label", "n", *R.chance(F.col("n")))


@query(f"""WITH {_COUNTS}, lab AS (SELECT label, count(*) AS m, list_sum(list_transform(range(1, count(*) + 1), lambda i: 1.0::DOUBLE / i)) / count(*) AS h FROM embeddings GROUP BY label)
SELECT round(avg(h), 9) AS ceiling, round((avg(1 / ({_AVG})) - 0.01) / (avg(h) - 0.01), 6) AS position FROM cnt JOIN lab USING (label)""")
def chance_ceiling(spark, sf):
    """AGG-27, MTH-05: mean chance level over strata, and where the metric lies between a floor of 0.01 and it."""
    ranked = counts(spark, sf)
    lab = B.vectors(spark, sf).groupBy("label").agg(F.count("*").alias("m"))
    h = F.aggregate(F.sequence(F.lit(1), F.col("m").cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i) / F.col("m")
    both = ranked.join(lab.select("label", h.alias("h")), "label")
    return both.agg(
        F.round(F.avg("h"), 9).alias("ceiling"),
        rounded((F.avg(1 / R.average_rank()) - 0.01) / (F.avg("h") - 0.01), 6).alias("position"),
    )


@query(f"""WITH {_E}, cap AS (SELECT vec_id, label, e, vec_id % 3 AS k FROM emb), judge AS (SELECT a.vec_id AS query_id, b.label AS signal, max(list_dot_product(a.e, b.e)) AS best
  FROM cap a JOIN cap b ON a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT query_id, count(*) FILTER (best > 0.3) AS n_relevant, round(max(best), 6) AS best FROM judge GROUP BY query_id""")
def judge_similarity(spark, sf):
    """MLO-05: best similarity to any caption of a signal (here a label's vectors), relevant above a threshold."""
    vec = B.vectors(spark, sf)
    best = R.best_by_label(vec, vec)
    return best.groupBy("query_id").agg(F.count_if(F.col("best") > 0.3).alias("n_relevant"), rounded(F.max("best"), 6).alias("best"))


@query(f"""WITH {_E} SELECT label, round(avg(sqrt(list_dot_product(e, e))), 6) AS mean_norm,
  count(*) FILTER (abs(sqrt(list_dot_product(e, e)) - 1) > 1e-3) AS n_off FROM emb GROUP BY label""")
def unit_norm_gate(spark, sf):
    """ARR-18, GAT-15: L2 norms of the vectors."""
    n = A.norm(F.col("vec"))
    return B.vectors(spark, sf).groupBy("label").agg(rounded(F.avg(n), 6).alias("mean_norm"), F.count_if(F.abs(n - 1) > 1e-3).alias("n_off"))


@query(f"""WITH {_E} SELECT label, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length, round(v[1], 6) AS first FROM (
  SELECT label, list_transform(range(1, 65), lambda j: list_avg(list_transform(list(e ORDER BY vec_id), lambda r: r[j]))) AS v FROM emb GROUP BY label)""")
def mean_pooled_vectors(spark, sf):
    """MTH-14: mean-pooled vector per label: its length and first value before normalising."""
    at = B.vectors(spark, sf).select("label", F.posexplode("vec").alias("j", "v"))
    means = at.groupBy("label", "j").agg(F.avg("v").alias("v"))
    return means.groupBy("label").agg(rounded(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("length"), rounded(F.max(F.when(F.col("j") == 0, F.col("v"))), 6).alias("first"))
