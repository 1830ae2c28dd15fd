"""Inference over per-item scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions.numbers import rounded
from quillon.operators import inference as I
from quillon.plans import base as B
from quillon.plans.registry import query
from quillon.session import read_table, stage

#: Replicates of the registered bootstraps.
REPLICATES = 2000
_S = f"WITH {B.SCORES_SQL}"


def outcome():
    return F.col("correct").cast("double")


def is_swap():
    return F.col("probe_condition") == "swap"


def is_random():
    return F.col("probe_condition") == "random"


def r6(c, name):
    return rounded(c, 6).alias(name)


def r8(c, name):
    """Eight digits, where six would cut interpolated values at exact halves."""
    return rounded(c, 8).alias(name)


@query(f"""{_S} SELECT seed, component, round(avg(correct::INT) FILTER (probe_condition = 'swap'), 6) AS swap_acc, round(avg(correct::INT) FILTER (probe_condition = 'random'), 6) AS random_acc,
  round(avg(margin), 6) AS mean_margin, round(avg(correct::INT) FILTER (probe_condition = 'random') - avg(correct::INT) FILTER (probe_condition = 'swap'), 6) AS gap FROM scores GROUP BY seed, component""")
def accuracy_gap(spark, sf):
    """AGG-02: accuracy and margin by seed and component, gap random minus swap."""
    swap, random = F.avg(F.when(is_swap(), outcome())), F.avg(F.when(is_random(), outcome()))
    return B.scores(spark, sf).groupBy("seed", "component").agg(r6(swap, "swap_acc"), r6(random, "random_acc"), r6(F.avg("margin"), "mean_margin"), r6(random - swap, "gap"))


@query(f"""{_S} SELECT sample_id, count(*) FILTER (probe_condition = 'swap' AND correct) AS swap_right, count(*) FILTER (probe_condition = 'swap' AND NOT correct) AS swap_wrong,
  count(*) FILTER (probe_condition = 'random' AND correct) AS random_right, count(*) FILTER (probe_condition = 'random' AND NOT correct) AS random_wrong FROM scores GROUP BY sample_id""")
def per_signal_counts(spark, sf):
    """AGG-03."""
    right = F.col("correct")
    return B.scores(spark, sf).groupBy("sample_id").agg(
        F.count_if(is_swap() & right).alias("swap_right"), F.count_if(is_swap() & ~right).alias("swap_wrong"), F.count_if(is_random() & right).alias("random_right"), F.count_if(is_random() & ~right).alias("random_wrong")
    )


_SEEDS = f"{_S}, a AS (SELECT seed, component, avg(correct::INT) AS acc FROM scores GROUP BY seed, component)"


@query(f"""{_SEEDS} SELECT component, round(avg(acc), 6) AS mean, round(stddev_samp(acc), 6) AS sd, round(min(acc), 6) AS low, round(max(acc), 6) AS high, count(*) AS n,
  round(CASE count(*) WHEN 4 THEN 3.182 WHEN 3 THEN 4.303 WHEN 2 THEN 12.706 END * stddev_samp(acc) / sqrt(count(*)), 6) AS half_width, round(stddev_samp(acc) / avg(acc) * 100, 4) AS noise_pct,
  bool_and(acc > 0.5) AS all_above, bool_or(acc > 0.5) AS any_above FROM a GROUP BY component""")
def seed_summary(spark, sf):
    """AGG-06, AGG-07, AGG-14, STA-19: mean of per-seed means, t interval, noise floor, replication over seeds."""
    a = B.scores(spark, sf).groupBy("seed", "component").agg(F.avg(outcome()).alias("acc"))
    sd, n = F.stddev_samp("acc"), F.count("*")
    return a.groupBy("component").agg(
        r6(F.avg("acc"), "mean"), r6(sd, "sd"), r6(F.min("acc"), "low"), r6(F.max("acc"), "high"), n.alias("n"), r6(I.t_half_width(sd, n), "half_width"), rounded(sd / F.avg("acc") * 100, 4).alias("noise_pct"),
        F.bool_and(F.col("acc") > 0.5).alias("all_above"), F.bool_or(F.col("acc") > 0.5).alias("any_above"),
    )


@query(f"""{_S} SELECT component, round(sum(s)::DOUBLE / sum(n), 6) AS pooled, round(avg(s::DOUBLE / n), 6) AS macro, count(*) AS n_signals FROM
  (SELECT component, sample_id, sum(correct::INT) AS s, count(*) AS n FROM scores GROUP BY ALL) GROUP BY component""")
def sufficient_stats_mean(spark, sf):
    """AGG-17, AGG-25, AGG-31: pooled mean from sums and counts, and the macro mean over signals."""
    per = B.scores(spark, sf).groupBy("component", "sample_id").agg(F.sum(F.col("correct").cast("int")).alias("s"), F.count("*").alias("n"))
    return per.groupBy("component").agg(r6(F.sum("s") / F.sum("n"), "pooled"), r6(F.avg(F.col("s") / F.col("n")), "macro"), F.count("*").alias("n_signals"))


def clusters(spark, sf):
    """Per component and sample: sums of outcomes and counts in each condition. Staged, since they are read twice or more."""
    sums = B.scores(spark, sf).where("sample_id is not null").groupBy("component", "sample_id").agg(
        F.sum(F.when(is_swap(), outcome()).otherwise(0.0)).alias("ss"), F.count_if(is_swap()).alias("sn"), F.sum(F.when(is_random(), outcome()).otherwise(0.0)).alias("rs"), F.count_if(is_random()).alias("rn")
    )
    return stage(sums, "sums")


_PICK = "('0x' || substr(md5('42|' || b || '|' || j), 1, 12))::BIGINT % k"
_BOOT = f"""{_S}, cl AS (SELECT component, sample_id, coalesce(sum(correct::INT) FILTER (probe_condition = 'swap'), 0) AS ss, count(*) FILTER (probe_condition = 'swap') AS sn,
  coalesce(sum(correct::INT) FILTER (probe_condition = 'random'), 0) AS rs, count(*) FILTER (probe_condition = 'random') AS rn FROM scores WHERE sample_id IS NOT NULL GROUP BY ALL),
ix AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY md5(sample_id), sample_id) - 1 AS idx, count(*) OVER (PARTITION BY component) AS k FROM cl),
dr AS (SELECT component, k, b, unnest(range(0, k)) AS j FROM (SELECT DISTINCT component, k FROM ix), range(0, {REPLICATES}) t(b)),
rep AS (SELECT d.component, b, sum(ss) AS ss, sum(sn) AS sn, sum(rs) AS rs, sum(rn) AS rn FROM (SELECT *, {_PICK} AS idx FROM dr) d JOIN ix ON ix.component = d.component AND ix.idx = d.idx GROUP BY ALL)"""


@query(f"""{_BOOT} SELECT component, count(*) AS n_rep, round(quantile_cont((ss + rs)::DOUBLE / (sn + rn), 0.025), 6) AS low, round(quantile_cont((ss + rs)::DOUBLE / (sn + rn), 0.975), 6) AS high FROM rep GROUP BY component""")
def cluster_bootstrap_ci(spark, sf):
    """STA-01, STA-02: cluster bootstrap of accuracy from per-cluster sums."""
    rep = I.bootstrap(clusters(spark, sf), ["component"], "sample_id", ["ss", "sn", "rs", "rn"], REPLICATES)
    n = F.col("sn") + F.col("rn")
    low, high = I.interval(F.when(n > 0, (F.col("ss") + F.col("rs")) / n).otherwise(float("nan")))  # as the SQL, where no draw has either condition
    return rep.groupBy("component").agg(F.count("*").alias("n_rep"), r6(low, "low"), r6(high, "high"))


_GAP = f"{_BOOT}, g AS (SELECT component, b, rs::DOUBLE / rn - ss::DOUBLE / sn AS gap FROM rep WHERE rn > 0 AND sn > 0)"


@query(f"""{_GAP} SELECT component, round(quantile_cont(gap, 0.025), 8) AS low95, round(quantile_cont(gap, 0.975), 8) AS high95, round(quantile_cont(gap, 0.05), 8) AS low90, round(quantile_cont(gap, 0.95), 8) AS high90,
  round(2 * least(avg((gap <= 0)::INT), avg((gap >= 0)::INT)), 8) AS p, quantile_cont(gap, 0.05) > -0.2 AND quantile_cont(gap, 0.95) < 0.2 AS equivalent FROM g GROUP BY component""")
def bootstrap_gap(spark, sf):
    """STA-03, STA-08, STA-18: intervals of the gap, its bootstrap p and the equivalence verdict."""
    rep = I.bootstrap(clusters(spark, sf), ["component"], "sample_id", ["ss", "sn", "rs", "rn"], REPLICATES)
    g = rep.where("rn > 0 and sn > 0").withColumn("gap", F.col("rs") / F.col("rn") - F.col("ss") / F.col("sn"))
    gap = F.col("gap")
    (l95, h95), (l90, h90) = I.interval(gap), I.interval(gap, 0.90)
    p = 2 * F.least(F.avg((gap <= 0).cast("double")), F.avg((gap >= 0).cast("double")))
    return g.groupBy("component").agg(r8(l95, "low95"), r8(h95, "high95"), r8(l90, "low90"), r8(h90, "high90"), r8(p, "p"), I.equivalent(l90, h90, 0.2).alias("equivalent"))


@query(f"""{_GAP}, base AS (SELECT component, sum(ss)::DOUBLE / sum(sn) AS acc FROM cl GROUP BY component), ci AS (SELECT component, quantile_cont(gap, 0.025) AS lo, quantile_cont(gap, 0.975) AS hi,
  quantile_cont(gap, 0.05) AS l9, quantile_cont(gap, 0.95) AS h9 FROM g GROUP BY component)
SELECT component, CASE WHEN acc < 0.3 THEN 'VOID' WHEN lo > 0 THEN 'DEGRADED' WHEN hi < 0 THEN 'IMPROVED' WHEN l9 > -0.2 AND h9 < 0.2 THEN 'EQUIVALENT' ELSE 'INCONCLUSIVE' END AS verdict FROM ci JOIN base USING (component)""")
def replication_verdict(spark, sf):
    """STA-15, STA-16: verdict algebra over intervals, void when the reference cell is too low."""
    cl = clusters(spark, sf)
    g = I.bootstrap(cl, ["component"], "sample_id", ["ss", "sn", "rs", "rn"], REPLICATES).where("rn > 0 and sn > 0").withColumn("gap", F.col("rs") / F.col("rn") - F.col("ss") / F.col("sn"))
    (lo, hi), (l9, h9) = I.interval(F.col("gap")), I.interval(F.col("gap"), 0.90)
    ci = g.groupBy("component").agg(lo.alias("lo"), hi.alias("hi"), l9.alias("l9"), h9.alias("h9"))
    base = cl.groupBy("component").agg(F.try_divide(F.sum("ss"), F.sum("sn")).alias("acc"))  # a component without swaps has no interval
    verdict = (
        F.when(F.col("acc") < 0.3, "VOID").when(F.col("lo") > 0, "DEGRADED").when(F.col("hi") < 0, "IMPROVED").when(I.equivalent(F.col("l9"), F.col("h9"), 0.2), "EQUIVALENT").otherwise("INCONCLUSIVE")
    )
    return ci.join(base, "component").select("component", verdict.alias("verdict"))


_PW = " + ".join(f"(u > {c!r}::DOUBLE)::INT" for c in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253))
_PU = B.U_SQL.format("'p42|' || b || '|' || sample_id")


@query(f"""{_S}, cl AS (SELECT component, sample_id, sum(correct::INT) AS s, count(*) AS n FROM scores WHERE sample_id IS NOT NULL GROUP BY ALL),
w AS (SELECT *, {_PU} AS u FROM cl, range(0, {REPLICATES}) t(b)), rep AS (SELECT component, b, sum(s * ({_PW}))::DOUBLE / sum(n * ({_PW})) AS m FROM w GROUP BY ALL HAVING sum({_PW}) > 0)
SELECT component, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM rep GROUP BY component""")
def poisson_bootstrap_ci(spark, sf):
    """STA-01 without an index over clusters: Poisson weights, map-side sums only."""
    cl = B.scores(spark, sf).where("sample_id is not null").groupBy("component", "sample_id").agg(F.sum(F.col("correct").cast("int")).alias("s"), F.count("*").alias("n"))
    rep = I.poisson_bootstrap(cl, ["component"], "sample_id", ["s", "n"], REPLICATES).withColumn("m", F.col("s") / F.col("n"))
    low, high = I.interval(F.col("m"))
    return rep.groupBy("component").agg(r6(low, "low"), r6(high, "high"))


_DID = f"""{_BOOT}, t AS (SELECT a.component AS first_component, b.component AS second_component, a.b, (a.rs::DOUBLE / a.rn - a.ss::DOUBLE / a.sn) - (b.rs::DOUBLE / b.rn - b.ss::DOUBLE / b.sn) AS d
  FROM rep a JOIN rep b ON a.b = b.b AND a.component < b.component WHERE a.rn > 0 AND a.sn > 0 AND b.rn > 0 AND b.sn > 0)"""


@query(f"{_DID} SELECT first_component, second_component, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM t GROUP BY ALL")
def did_independent(spark, sf):
    """STA-05, STA-06, STA-14: difference of gaps between two independently resampled groups, replicate by replicate."""
    rep = I.bootstrap(clusters(spark, sf), ["component"], "sample_id", ["ss", "sn", "rs", "rn"], REPLICATES).where("rn > 0 and sn > 0")
    gap = rep.select("component", "b", (F.col("rs") / F.col("rn") - F.col("ss") / F.col("sn")).alias("g"))
    legs = gap.groupBy("b").agg(F.collect_list(F.struct("component", "g")).alias("legs"))  # one pass over the replicates, no join
    first = legs.select("b", "legs", F.explode("legs").alias("x"))
    t = first.select("x", F.explode(F.filter("legs", lambda y: F.col("x.component") < y["component"])).alias("y"))
    t = t.select(F.col("x.component").alias("first_component"), F.col("x.g").alias("g1"), F.col("y.component").alias("second_component"), F.col("y.g").alias("g2"))
    d = F.col("g1") - F.col("g2")
    low, high = I.interval(d)
    return t.groupBy("first_component", "second_component").agg(r6(F.avg(d), "mean"), r6(low, "low"), r6(high, "high"))


@query(f"""{_S}, cl AS (SELECT sample_id, coalesce(sum(margin) FILTER (probe_condition = 'swap' AND seed = lo), 0) AS a, count(*) FILTER (probe_condition = 'swap' AND seed = lo) AS an,
  coalesce(sum(margin) FILTER (probe_condition = 'random' AND seed = lo), 0) AS c, count(*) FILTER (probe_condition = 'random' AND seed = lo) AS cn FROM scores, (SELECT min(seed) AS lo FROM scores) WHERE sample_id IS NOT NULL GROUP BY sample_id),
ix AS (SELECT *, row_number() OVER (ORDER BY md5(sample_id), sample_id) - 1 AS idx, count(*) OVER () AS k FROM cl),
dr AS (SELECT k, b, unnest(range(0, k)) AS j FROM (SELECT DISTINCT k FROM ix), range(0, {REPLICATES}) t(b)),
rep AS (SELECT b, sum(a) / sum(an) AS m1, sum(c) / sum(cn) AS m2 FROM (SELECT b, {_PICK} AS idx FROM dr) d JOIN ix USING (idx) GROUP BY b HAVING sum(an) > 0 AND sum(cn) > 0)
SELECT count(*) AS n_rep, round(quantile_cont(m1 - m2, 0.025), 6) AS low, round(quantile_cont(m1 - m2, 0.975), 6) AS high FROM rep""")
def did_joint(spark, sf):
    """STA-04, STA-07: one set of draws shared by both legs, replicates without a leg dropped."""
    s = B.scores(spark, sf)
    low_seed = s.agg(F.min("seed").alias("lo"))  # one row; of all scores, also those without a sample
    s = s.where("sample_id is not null").join(F.broadcast(low_seed), F.col("seed") == F.col("lo"), "left")
    a, c = is_swap() & F.col("lo").isNotNull(), is_random() & F.col("lo").isNotNull()
    cl = s.groupBy("sample_id").agg(
        F.sum(F.when(a, F.col("margin")).otherwise(0.0)).alias("a"), F.count_if(a).alias("an"), F.sum(F.when(c, F.col("margin")).otherwise(0.0)).alias("c"), F.count_if(c).alias("cn")
    )
    rep = I.bootstrap(stage(cl, "sums"), [], "sample_id", ["a", "an", "c", "cn"], REPLICATES).where("an > 0 and cn > 0")  # read twice
    lo, hi = I.interval(F.col("a") / F.col("an") - F.col("c") / F.col("cn"))
    return rep.agg(F.count("*").alias("n_rep"), r6(lo, "low"), r6(hi, "high"))


_PAIRED = f"""{_S}, m AS (SELECT component, pair_key, round(avg(margin) FILTER (probe_condition = 'swap') - avg(margin) FILTER (probe_condition = 'random'), 6) AS d FROM scores GROUP BY component, pair_key)"""


def paired(spark, sf):
    """Per twin pair the difference of mean margins, swap minus random; null without a twin."""
    d = F.avg(F.when(is_swap(), F.col("margin"))) - F.avg(F.when(is_random(), F.col("margin")))
    return B.scores(spark, sf).groupBy("component", "pair_key").agg(r6(d, "d"))


_WX = f"""{_PAIRED}, u AS (SELECT component, d, abs(d) AS s FROM m WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY component ORDER BY s) + (count(*) OVER (PARTITION BY component, s) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY component, s) AS t FROM u),
w AS (SELECT component, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN rk ELSE 0 END) AS wm, sum(t * t - 1) AS corr FROM r GROUP BY component)"""


@query(f"{_WX} SELECT component, n::BIGINT AS n, wp AS w_plus, wm AS w_minus, round((wp - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - corr / 48.0), 6) AS z FROM w")
def wilcoxon_w(spark, sf):
    """STA-09: signed-rank statistic and z."""
    return I.wilcoxon(paired(spark, sf), ["component"], "d").withColumn("z", rounded("z", 6))


@query()
def wilcoxon_p(spark, sf):
    """STA-09 with p-values (no error function in SQL)."""
    w = I.wilcoxon(paired(spark, sf), ["component"], "d")
    return w.select("component", rounded(I.normal_p(F.col("z")), 6).alias("p_two_sided"), rounded(I.normal_p(F.col("z"), False), 6).alias("p_greater"))


@query(f"""{_S}, r AS (SELECT component, probe_condition = 'swap' AS first, rank() OVER (PARTITION BY component ORDER BY margin) + (count(*) OVER (PARTITION BY component, margin) - 1) / 2.0::DOUBLE AS rk,
  count(*) OVER (PARTITION BY component, margin) AS t FROM scores),
g AS (SELECT component, count(*) FILTER (first)::DOUBLE AS n1, count(*) FILTER (NOT first)::DOUBLE AS n2, sum(rk) FILTER (first) AS r1, sum(t * t - 1)::DOUBLE AS c FROM r GROUP BY component)
SELECT component, n1::BIGINT AS n1, n2::BIGINT AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - c / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM g""")
def mannwhitney_u(spark, sf):
    """STA-10."""
    s = B.scores(spark, sf).select("component", "margin", is_swap().alias("first"))
    return I.mann_whitney(s, ["component"], "margin", "first").withColumn("z", rounded("z", 6))


_TWIN = f"""{_S}, t AS (SELECT seed, component, pair_key, bool_and(correct) FILTER (probe_condition = 'swap') AS sw, bool_and(correct) FILTER (probe_condition = 'random') AS rd FROM scores GROUP BY ALL),
bc AS (SELECT seed, component, count(*) FILTER (sw AND NOT rd) AS b, count(*) FILTER (rd AND NOT sw) AS c FROM t GROUP BY ALL)"""
_MCN = """CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END"""


def discordant(spark, sf):
    """Per seed and component: twin pairs right only under swap (b) or only under random (c)."""
    twin = B.scores(spark, sf).groupBy("seed", "component", "pair_key").agg(F.bool_and(F.when(is_swap(), F.col("correct"))).alias("sw"), F.bool_and(F.when(is_random(), F.col("correct"))).alias("rd"))
    return twin.groupBy("seed", "component").agg(F.count_if(F.col("sw") & ~F.col("rd")).alias("b"), F.count_if(F.col("rd") & ~F.col("sw")).alias("c"))


@query(f"{_TWIN} SELECT seed, component, b, c, round({_MCN}, 6) AS p FROM bc")
def mcnemar_exact(spark, sf):
    """STA-11: exact test on discordant twins."""
    return discordant(spark, sf).select("seed", "component", "b", "c", r6(I.mcnemar_exact(F.col("b"), F.col("c")), "p"))


_HOLM = f"{_TWIN}, p AS (SELECT seed, component, round({_MCN}, 6) AS p FROM bc), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY seed) - row_number() OVER w + 1) * p) AS step FROM p WINDOW w AS (PARTITION BY seed ORDER BY p, component))"


@query(f"{_HOLM} SELECT seed, component, p, round(max(step) OVER (PARTITION BY seed ORDER BY p, component ROWS UNBOUNDED PRECEDING), 6) AS p_holm, round(step, 6) AS p_step FROM s")
def holm(spark, sf):
    """WIN-07, WIN-08, STA-12: step-down correction, monotone and not."""
    p = discordant(spark, sf).select("seed", "component", r6(I.mcnemar_exact(F.col("b"), F.col("c")), "p"))
    both = I.holm(I.holm(p, ["seed"], "p", ["component"]), ["seed"], "p", ["component"], monotone=False, out="p_step")
    return both.select("seed", "component", "p", r6(F.col("p_holm"), "p_holm"), r6(F.col("p_step"), "p_step"))


@query(f"""{_S}, k AS (SELECT component, count(*) FILTER (correct)::DOUBLE AS k, count(*)::DOUBLE AS n FROM scores GROUP BY component)
SELECT component, round((k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low,
  round((k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM k""")
def wilson_ci(spark, sf):
    """MTH-11."""
    k = B.scores(spark, sf).groupBy("component").agg(F.count_if("correct").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = I.wilson(F.col("k"), F.col("n"))
    return k.select("component", r6(low, "low"), r6(high, "high"))


_UP = f"""{_S}, u AS (SELECT component, array_to_string(list_sort([swap_from, swap_to]), '|') AS pair, round(avg(margin) FILTER (probe_condition = 'swap'), 6) AS a, round(avg(margin) FILTER (probe_condition = 'random'), 6) AS b
  FROM scores WHERE swap_from IS NOT NULL AND swap_to IS NOT NULL GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"""


def unordered_pairs(spark, sf):
    """Mean margins per unordered pair of swapped values."""
    pair = F.array_join(F.array_sort(F.array("swap_from", "swap_to")), "|")
    u = B.scores(spark, sf).where("swap_from is not null and swap_to is not null").groupBy("component", pair.alias("pair"))
    return u.agg(r6(F.avg(F.when(is_swap(), F.col("margin"))), "a"), r6(F.avg(F.when(is_random(), F.col("margin"))), "b")).where("a is not null and b is not null")


@query(f"""{_UP}, r AS (SELECT component, a, b, rank() OVER (PARTITION BY component ORDER BY a) + (count(*) OVER (PARTITION BY component, a) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY component ORDER BY b) + (count(*) OVER (PARTITION BY component, b) - 1) / 2.0::DOUBLE AS rb FROM u)
SELECT component, count(*) AS n, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman FROM r GROUP BY component HAVING count(*) >= 3""")
def spearman_pairs(spark, sf):
    """MTH-09, MTH-10, JON-07, FLT-06: correlation over unordered pairs with a minimum support."""
    r = I.average_ranks(I.average_ranks(unordered_pairs(spark, sf), ["component"], "a", "ra"), ["component"], "b", "rb")
    return r.groupBy("component").agg(F.count("*").alias("n"), rounded(I.correlation("a", "b"), 5).alias("pearson"), rounded(I.correlation("ra", "rb"), 5).alias("spearman")).where("n >= 3")


@query(f"""{_UP}, ix AS (SELECT a, b, row_number() OVER (ORDER BY md5(component || '#' || pair), component || '#' || pair) - 1 AS idx, count(*) OVER () AS k FROM u),
dr AS (SELECT k, b AS rep, unnest(range(0, k)) AS j FROM (SELECT DISTINCT k FROM ix), range(0, {REPLICATES}) t(b)),
rp AS (SELECT rep, corr(a, b) AS r FROM (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || j), 1, 12))::BIGINT % k AS idx FROM dr) d JOIN ix USING (idx) GROUP BY rep)
SELECT count(*) AS n_rep, round(quantile_cont(r, 0.025), 5) AS low, round(quantile_cont(r, 0.975), 5) AS high FROM rp WHERE r IS NOT NULL AND NOT isnan(r)""")
def corr_bootstrap(spark, sf):
    """STA-13: bootstrap of a correlation over pairs from five sums per replicate."""
    a, b = F.col("a"), F.col("b")
    one = F.lit(1.0)
    u = unordered_pairs(spark, sf).select(F.concat_ws("#", "component", "pair").alias("key"), a.alias("sa"), b.alias("sb"), (a * a).alias("saa"), (b * b).alias("sbb"), (a * b).alias("sab"), one.alias("n"))
    rep = I.bootstrap(u, [], "key", ["sa", "sb", "saa", "sbb", "sab", "n"], REPLICATES)
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / F.col("n"), F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")
    r = rep.select(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("r")).where("r is not null")
    low, high = I.interval(F.col("r"))
    return r.agg(F.count("*").alias("n_rep"), rounded(low, 5).alias("low"), rounded(high, 5).alias("high"))


@query(f"""{_S}, c AS (SELECT sample_id, sum(margin) AS s, count(*) AS n FROM scores WHERE sample_id IS NOT NULL GROUP BY sample_id), t AS (SELECT sum(s) AS s, sum(n) AS n FROM c)
SELECT c.sample_id, round((t.s - c.s) / (t.n - c.n), 6) AS mean_without, round((t.s - c.s) / (t.n - c.n) - t.s / t.n, 6) AS shift FROM c, t""")
def leave_one_cluster_out(spark, sf):
    """STA-17: the mean without each cluster, from totals."""
    c = B.scores(spark, sf).where("sample_id is not null").groupBy("sample_id").agg(F.sum("margin").alias("s"), F.count("*").alias("n"))
    t = c.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))  # one row
    without = (F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))
    return c.crossJoin(F.broadcast(t)).select("sample_id", r6(without, "mean_without"), r6(without - F.col("ts") / F.col("tn"), "shift"))


_WC = "len(list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""{_S}, j AS (SELECT s.component, s.probe_condition, s.margin, {_WC.format('i.caption_correct')} - {_WC.format('i.caption_distractor')} AS diff FROM scores s JOIN probe1_items i USING (item_id) WHERE i.caption_distractor IS NOT NULL)
SELECT coalesce(component, 'all') AS component, probe_condition, count(*) AS n, round(CASE WHEN stddev_pop(diff) > 0 AND stddev_pop(margin) > 0 THEN corr(diff, margin) END, 5) AS r FROM j GROUP BY GROUPING SETS ((probe_condition), (component, probe_condition))""")
def length_margin_corr(spark, sf):
    """STA-22: correlation of length difference and margin, overall and per component."""
    from quillon.functions.text import word_count

    j = B.scores(spark, sf).select("item_id", "component", "probe_condition", "margin").join(
        read_table(spark, sf, "probe1_items").where("caption_distractor is not null").select("item_id", (word_count(F.col("caption_correct")) - word_count(F.col("caption_distractor"))).alias("diff")), "item_id"
    )
    sets = j.groupingSets([[F.col("probe_condition")], [F.col("component"), F.col("probe_condition")]], F.col("component"), F.col("probe_condition"))
    return sets.agg(F.count("*").alias("n"), rounded(I.correlation("diff", "margin"), 5).alias("r")).withColumn("component", F.coalesce("component", F.lit("all")))


@query(f"""{_S}, o AS (SELECT component, item_id, count(DISTINCT correct) AS k, count(*) AS n, avg(abs(margin)) AS m FROM scores GROUP BY ALL)
SELECT component, round(avg((k = 2)::INT), 6) AS flip_rate, round(avg(m), 6) AS mean_abs_margin, count(*) FILTER (n > 1 AND k = 1) AS n_consistent FROM o GROUP BY component""")
def flip_rate(spark, sf):
    """STA-20, STA-21: outcomes that flip between runs, mean absolute margin, consistent items."""
    o = B.scores(spark, sf).groupBy("component", "item_id").agg(F.countDistinct("correct").alias("k"), F.count("*").alias("n"), F.avg(F.abs("margin")).alias("m"))
    return o.groupBy("component").agg(r6(F.avg((F.col("k") == 2).cast("double")), "flip_rate"), r6(F.avg("m"), "mean_abs_margin"), F.count_if(F.expr("n > 1 and k = 1")).alias("n_consistent"))


@query(f"""{_S}, t AS (SELECT CASE WHEN i.clause_replaced_from IS NULL THEN 'no clause' ELSE 'clause' END AS part, s.* FROM scores s JOIN probe1_items i USING (item_id))
SELECT part, count(*) AS n, count(DISTINCT pair_key) AS n_pairs, round(avg(correct::INT), 6) AS acc, round(avg(margin), 6) AS margin, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY margin), 6) AS median FROM t GROUP BY part""")
def partition_report(spark, sf):
    """STA-23: the same cells by a partition of the items."""
    part = F.when(F.col("clause_replaced_from").isNull(), "no clause").otherwise("clause")
    t = B.scores(spark, sf).join(read_table(spark, sf, "probe1_items").select("item_id", part.alias("part")), "item_id")
    return t.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("pair_key").alias("n_pairs"), r6(F.avg(outcome()), "acc"), r6(F.avg("margin"), "margin"), r6(F.median("margin"), "median"))


@query(f"""{_S} SELECT component, round(quantile_cont(margin, 0.025), 8) AS p025, round(quantile_cont(margin, 0.5), 8) AS p50, round(quantile_cont(margin, 0.975), 8) AS p975,
  round(list_sort(list(margin))[count(*) // 2 + 1], 8) AS upper_median, round(max(margin) - min(margin), 8) AS spread FROM scores GROUP BY component""")
def percentiles(spark, sf):
    """AGG-08, AGG-09, AGG-23: exact percentiles, upper median, spread."""
    m = F.col("margin")
    w = W.partitionBy("component").orderBy("margin")
    ranked = B.scores(spark, sf).withColumn("nth", F.row_number().over(w)).withColumn("k", F.count("*").over(W.partitionBy("component")))
    return ranked.groupBy("component").agg(
        r8(F.percentile(m, F.lit(0.025)), "p025"), r8(F.percentile(m, F.lit(0.5)), "p50"), r8(F.percentile(m, F.lit(0.975)), "p975"), r8(F.max(F.when(F.expr("nth = k div 2 + 1"), m)), "upper_median"), r8(F.max(m) - F.min(m), "spread")
    )


@query(f"""{_S} SELECT component, seed, round(sum(margin) / count(*), 6) AS mean, round(sqrt(greatest(sum(margin * margin) / count(*) - power(sum(margin) / count(*), 2), 0)), 5) AS sd, count(*) AS n,
  CASE WHEN max(margin) = max(abs(margin)) THEN 'up' ELSE 'down' END AS reach, arg_max(item_id, struct_pack(m := margin, i := item_id)) AS best_item FROM scores GROUP BY component, seed""")
def moments(spark, sf):
    """AGG-18, AGG-20: mean and sd from sums, arg-max."""
    m = F.col("margin")
    mean = F.sum(m) / F.count("*")
    return B.scores(spark, sf).groupBy("component", "seed").agg(
        r6(mean, "mean"), rounded(F.sqrt(F.greatest(F.sum(m * m) / F.count("*") - mean * mean, F.lit(0.0))), 5).alias("sd"), F.count("*").alias("n"),
        F.when(F.max(m) == F.max(F.abs(m)), "up").otherwise("down").alias("reach"), F.max_by("item_id", F.struct("margin", "item_id")).alias("best_item"),
    )


@query(f"""{_S}, a AS (SELECT seed, component, avg(margin) FILTER (probe_condition = 'random') - avg(margin) FILTER (probe_condition = 'swap') AS d FROM scores GROUP BY ALL),
o AS (SELECT seed, string_agg(component, ' > ' ORDER BY round(d, 6) DESC NULLS LAST, component) AS severity FROM a GROUP BY seed)
SELECT seed, severity, (SELECT count(DISTINCT severity) FROM o) AS n_orders FROM o""")
def severity_order(spark, sf):
    """SRT-07: components ordered by degradation per seed, and how many different orders there are."""
    d = rounded(F.avg(F.when(is_random(), F.col("margin"))) - F.avg(F.when(is_swap(), F.col("margin"))), 6)
    a = B.scores(spark, sf).groupBy("seed", "component").agg(d.alias("d"))
    key = F.struct(F.coalesce(-F.col("d"), F.lit(float("inf"))).alias("k"), "component")
    o = a.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["component"]), " > ").alias("severity"))
    n = o.agg(F.countDistinct("severity").alias("n_orders"))  # one row
    return o.crossJoin(F.broadcast(n))
