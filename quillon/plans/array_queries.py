"""Perturbations, surrogates and checks on series (one series per sample), with order-sensitive exact digests."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import arrays as A
from quillon.functions import hashing as H
from quillon.functions.numbers import rounded
from quillon.plans import base as B
from quillon.plans.registry import query
from quillon.session import read_table


def xs():
    return F.col("x")


def sid():
    return F.col("sample_id")


_P = f"WITH {B.POOL_SQL}"
_ALL = B.ORDER_SQL.format(n="len(x)", c="sf_all")
_HALF = B.ORDER_SQL.format(n="len(x) // 2", c="sf_half")
_MASKED = f"list_slice({B.ORDER_SQL.format(n='len(x)', c='masking')}, 1, CAST(floor(len(x) * 0.2) AS BIGINT))"
_ZN = """(CASE WHEN list_max(x) = list_min(x) THEN list_transform(x, lambda v: 0.0::DOUBLE)
  ELSE list_transform(x, lambda v: (v - m) / s) END)"""
_MS = """ms AS (SELECT *, list_sum(list_transform(x, lambda v: (v - m) * (v - m))) AS ss,
  sqrt(list_sum(list_transform(x, lambda v: (v - m) * (v - m))) / len(x)) AS s FROM (SELECT sample_id, x, list_sum(x) / len(x) AS m FROM pool))"""


def _d(sql: str) -> str:
    return B.DIGEST_SQL.format(sql)


@query(f"{_P}, {_MS} SELECT sample_id, len(x) AS n, round(m, 6) AS mean, round(s, 6) AS sd, round(list_max(z), 6) AS top, round(list_min(z), 6) AS bottom FROM (SELECT *, {_ZN} AS z FROM ms)")
def znorm_series(spark, sf):
    """MTH-01: population z-norm, constant series to zeros."""
    z = A.znorm(xs())
    return B.pool(spark, sf).select(
        "sample_id", F.size("x").cast("long").alias("n"), rounded(A.mean(xs()), 6).alias("mean"), rounded(A.pop_sd(xs()), 6).alias("sd"), z.alias("z")
    ).select("sample_id", "n", "mean", "sd", rounded(F.array_max("z"), 6).alias("top"), rounded(F.array_min("z"), 6).alias("bottom"))


@query(f"{_P} SELECT sample_id, {_d(f'list_transform({_ALL}, lambda i: x[i + 1])')} AS digest FROM pool")
def perm_all(spark, sf):
    """ARR-01."""
    return B.pool(spark, sf).select("sample_id", A.digest(A.permute(xs(), sid())).alias("digest"))


@query(f"{_P} SELECT sample_id, {_d(f'list_concat(list_transform({_HALF}, lambda i: x[i + 1]), x[len(x) // 2 + 1 : len(x)])')} AS digest FROM pool")
def perm_half(spark, sf):
    """ARR-02."""
    return B.pool(spark, sf).select("sample_id", A.digest(A.permute_first_half(xs(), sid())).alias("digest"))


@query(f"{_P} SELECT sample_id, {_d('list_concat(x[len(x) // 2 + 1 : len(x)], x[1 : len(x) // 2])')} AS digest FROM pool")
def half_swap(spark, sf):
    """ARR-03."""
    return B.pool(spark, sf).select("sample_id", A.digest(A.swap_halves(xs())).alias("digest"))


@query(f"""{_P}, {_MS}, z AS (SELECT sample_id, {_ZN} AS z, {_MASKED} AS pos FROM ms)
SELECT sample_id, len(pos) AS k, list_sum(list_transform(z, lambda v, i: i * CAST(round(round(CASE WHEN list_contains(pos, i - 1) THEN 0.0 ELSE v END, 4) * 10000) AS BIGINT)))::BIGINT AS digest,
  len(list_filter(pos, lambda i: z[i + 1] = 0)) AS already_zero FROM z""")
def mask_zero(spark, sf):
    """ARR-04: masked positions of the normalised series set to zero, and how many were zero already."""
    both = F.struct(A.znorm(xs()).alias("z"), A.masked_positions(xs(), sid(), 42).alias("at"))

    def measured(p):
        filled = A.fill_at(p["z"], p["at"], F.lit(0.0))
        terms = F.transform(filled, lambda v, i: (i + 1).cast("long") * F.round(rounded(v, 4) * 10000).cast("long"))
        return F.struct(
            F.size(p["at"]).cast("long").alias("k"),
            F.aggregate(terms, F.lit(0).cast("long"), lambda a, v: a + v).alias("digest"),
            F.size(F.filter(p["at"], lambda i: F.get(p["z"], i) == 0)).cast("long").alias("already_zero"),
        )

    return B.pool(spark, sf).select("sample_id", A.bind(both, measured).alias("m")).select("sample_id", "m.*")


@query(f"""{_P}, m AS (SELECT sample_id, x, {_MASKED} AS pos FROM pool),
l AS (SELECT *, list_filter(x, lambda v, i: NOT list_contains(pos, i - 1)) AS kept FROM m)
SELECT sample_id, round(list_sum(kept) / len(kept), 6) AS survivor_mean, len(x) AS n, len(pos) AS k FROM l""")
def mask_survivor_mean(spark, sf):
    """ARR-05: mean-preserving masking; the mean of the filled series is that of the survivors."""
    y = A.bind(A.mask_with_mean(xs(), sid()), lambda y: A.mean(y))
    k = F.floor(F.size("x") * F.lit(0.2))
    return B.pool(spark, sf).select("sample_id", rounded(y, 6).alias("survivor_mean"), F.size("x").cast("long").alias("n"), k.alias("k"))


@query(f"""{_P} SELECT sample_id, {_d("list_transform(list_sort(list_transform(x, lambda v, i: {'b': (i - 1) // 16, 'h': md5(sample_id || '|sf_within_patch|42|' || (i - 1)), 'v': v})), lambda s: s.v)")} AS digest FROM pool""")
def patch_within(spark, sf):
    """ARR-06."""
    return B.pool(spark, sf).select("sample_id", A.digest(A.permute_within_patches(xs(), sid())).alias("digest"))


_ACROSS = B.ORDER_SQL.format(n="ceil(len(x) / 16)::INT", c="sf_across_patch")


@query(f"{_P} SELECT sample_id, {_d(f'flatten(list_transform({_ACROSS}, lambda i: x[i * 16 + 1 : i * 16 + 16]))')} AS digest FROM pool")
def patch_across(spark, sf):
    """ARR-07."""
    return B.pool(spark, sf).select("sample_id", A.digest(A.permute_patches(xs(), sid())).alias("digest"))


_U = B.U_SQL.format("sample_id || '|resample|42|' || (i - 1)")


@query(f"""{_P}, r AS (SELECT sample_id, x, list_transform(x, lambda v, i: floor({_U} * len(x))::INT) AS pos FROM pool)
SELECT sample_id, {_d('list_transform(pos, lambda i: x[i + 1])')} AS digest, round(1 - len(list_distinct(pos))::DOUBLE / len(x), 6) AS never_drawn FROM r""")
def resample_bag(spark, sf):
    """ARR-08: draws with replacement and the share of positions never drawn."""
    n = F.size("x")
    at = F.transform("x", lambda v, i: F.floor(H.uniform(A.key_at(sid(), "resample", 42, i)) * n).cast("int"))
    drawn = A.bind(at, lambda a: F.struct(A.digest(A.take(xs(), a)).alias("digest"), rounded(1 - F.size(F.array_distinct(a)) / n, 6).alias("never_drawn")))
    return B.pool(spark, sf).select("sample_id", drawn.alias("d")).select("sample_id", "d.*")


_GU, _GV = B.U_SQL.format("sample_id || '|gaussian_u|42|' || (i - 1)"), B.U_SQL.format("sample_id || '|gaussian_v|42|' || (i - 1)")


@query(f"""{_P}, {_MS}, g AS (SELECT sample_id, CASE WHEN list_max(x) = list_min(x) THEN x
  ELSE list_transform(x, lambda v, i: m + s * (sqrt(-2.0 * ln({_GU})) * cos(6.283185307179586::DOUBLE * {_GV}))) END AS y, m, s FROM ms)
SELECT sample_id, round(y[1], 6) AS first, round(list_max(y), 6) AS top, round(list_sum(y) / len(y), 6) AS mean FROM g""")
def gaussian_match(spark, sf):
    """ARR-09: matched normal surrogate."""
    y = B.pool(spark, sf).select("sample_id", A.gaussian(xs(), sid()).alias("y"))
    return y.select("sample_id", rounded(F.get("y", F.lit(0)), 6).alias("first"), rounded(F.array_max("y"), 6).alias("top"), rounded(A.mean(F.col("y")), 6).alias("mean"))


# --- several channels: the event types of a user, right-aligned to their common length
_CH = """ch AS (SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT user_id, min(len(v)) AS n FROM ch GROUP BY user_id),
blk AS (SELECT ch.user_id, event_type, v[len(v) - n + 1 : len(v)] AS v, n FROM ch JOIN w USING (user_id))"""


def channels(spark, sf):
    """(user_id, event_type, v, n, width): each user's event types cut to their common valid length n, all of it; width is
    the length of the user's longest channel."""
    ev = read_table(spark, sf, "events").where("value is not null")
    ch = ev.groupBy("user_id", "event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda s: s["value"]).alias("v"))
    user = W.partitionBy("user_id")
    ch = ch.withColumns({"n": F.min(F.size("v")).over(user), "width": F.max(F.size("v")).over(user)})
    return ch.withColumn("v", F.slice("v", F.size("v") - F.col("n") + 1, F.col("n")))


_CHORD = "list_transform(list_sort(list_transform(range(0, n), lambda i: {'h': md5(user_id || '|sf_all|42|' || i), 'i': i})), lambda s: s.i)"


@query(f"WITH {_CH} SELECT user_id, event_type, {_d(f'list_transform({_CHORD}, lambda i: v[i + 1])')} AS digest, n FROM blk")
def joint_channel_perm(spark, sf):
    """ARR-12, ARR-15: one permutation of the valid block for all channels of a user; padding stays where it is."""
    padded = F.concat(F.array_repeat(F.lit(0.0), F.col("width") - F.col("n")), F.col("v"))
    order = A.hash_order(F.col("n"), F.col("user_id").cast("string"), "sf_all", 42)
    moved = A.with_block(F.col("p"), A.take(A.valid_block(F.col("p"), F.col("n")), F.col("o")))
    return channels(spark, sf).select("user_id", "event_type", "n", padded.alias("p"), order.alias("o")).select(
        "user_id", "event_type", A.digest(A.valid_block(moved, F.col("n"))).alias("digest"), F.col("n").cast("long").alias("n")
    )


_DRAW = B.U_SQL.format("user_id || '|resample|' || r || '|' || i")


@query(f"""WITH {_CH}, usr AS (SELECT user_id, any_value(n) AS n, list(v ORDER BY event_type) AS vs FROM blk GROUP BY user_id),
c AS (SELECT user_id, n, vs, r, list_transform(range(0, n), lambda i: floor({_DRAW} * n)::INT) AS pos FROM usr, range(0, 9) t(r)),
f AS (SELECT user_id, r, n, vs, len(list_filter(vs, lambda v: list_max(list_transform(pos, lambda i: v[i + 1])) = list_min(list_transform(pos, lambda i: v[i + 1])) AND list_max(v) > list_min(v))) AS collapsed FROM c)
SELECT user_id, any_value(n) AS n, coalesce(min(r) FILTER (collapsed = 0), -1) AS draw, count(*) FILTER (collapsed > 0) AS n_collapsed FROM f GROUP BY user_id""")
def joint_channel_resample(spark, sf):
    """ARR-10: one resampling for all channels, redrawn up to eight times while a varying channel collapses (-1: never)."""
    usr = channels(spark, sf).groupBy("user_id").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("event_type", "v"))), lambda s: s["v"]).alias("vs"))
    drawn = usr.select("user_id", "n", "vs", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("r"))
    key = lambda i: F.concat(F.col("user_id").cast("string"), F.lit("|resample|"), F.col("r").cast("string"), F.lit("|"), i.cast("string"))
    at = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.floor(H.uniform(key(i)) * F.col("n")).cast("int"))
    flat = lambda at: F.exists("vs", lambda v: (A.spread(A.take(v, at)) == 0) & (A.spread(v) > 0))
    bad = drawn.withColumn("bad", A.bind(at, flat))
    return bad.groupBy("user_id").agg(
        F.first("n").cast("long").alias("n"), F.coalesce(F.min(F.when(~F.col("bad"), F.col("r"))), F.lit(-1)).cast("long").alias("draw"), F.count_if("bad").alias("n_collapsed")
    )


@query(f"""WITH {_CH}, z AS (SELECT user_id, event_type, v, n, list_sum(v) / n AS m, sqrt(list_sum(list_transform(v, lambda t: (t - list_sum(v) / n) * (t - list_sum(v) / n))) / n) AS s FROM blk)
SELECT event_type, count(*) AS n_channels, count(*) FILTER (list_max(v) = list_min(v)) AS n_dead, sum(n)::BIGINT AS n_points,
  sum(len(list_filter(v, lambda t: t = 0)))::BIGINT AS n_zero, round(sqrt(avg(m * m)), 4) AS rms_mean, round(avg(s), 4) AS mean_sd FROM z GROUP BY event_type""")
def channel_census(spark, sf):
    """AGG-30, MTH-02, ARR-11, ARR-14: dead channels, points, zeros, RMS of means, mean population sd per channel."""
    z = channels(spark, sf).select("event_type", "n", "v", A.mean(F.col("v")).alias("m"), A.pop_sd(F.col("v")).alias("s"))
    return z.groupBy("event_type").agg(
        F.count("*").alias("n_channels"),
        F.count_if(A.spread(F.col("v")) == 0).alias("n_dead"),
        F.sum("n").cast("long").alias("n_points"),
        F.sum(F.size(F.filter("v", lambda t: t == 0))).cast("long").alias("n_zero"),
        rounded(F.sqrt(F.avg(F.col("m") * F.col("m"))), 4).alias("rms_mean"),
        rounded(F.avg("s"), 4).alias("mean_sd"),
    )


@query(f"""{_P}, p AS (SELECT sample_id, x, list_transform({_ALL}, lambda i: x[i + 1]) AS a, list_concat(list_transform({_HALF}, lambda i: x[i + 1]), x[len(x) // 2 + 1 : len(x)]) AS h FROM pool)
SELECT count(*) AS n, count(*) FILTER (list_sort(a) = list_sort(x)) AS same_values, count(*) FILTER (h[len(x) // 2 + 1 : len(x)] = x[len(x) // 2 + 1 : len(x)]) AS tail_kept,
  count(*) FILTER (a = x) AS no_op, count(*) FILTER (list_max(x) = list_min(x) AND a = x) AS constant_unchanged FROM p""")
def applied_checks(spark, sf):
    """ARR-13, SET-08, GAT-08: multisets equal, tails untouched, no-ops counted, constant series unchanged."""
    rest = lambda y: F.slice(y, F.floor(F.size("x") / 2).cast("int") + 1, F.size("x"))
    p = B.pool(spark, sf).select("x", A.permute(xs(), sid()).alias("a"), A.permute_first_half(xs(), sid()).alias("h"))
    return p.agg(
        F.count("*").alias("n"),
        F.count_if(A.same_values(F.col("a"), xs())).alias("same_values"),
        F.count_if(rest(F.col("h")) == rest(xs())).alias("tail_kept"),
        F.count_if(F.col("a") == xs()).alias("no_op"),
        F.count_if((A.spread(xs()) == 0) & (F.col("a") == xs())).alias("constant_unchanged"),
    )


@query(f"{_P}, {_MS} SELECT sample_id, array_to_string(list_transform({_ZN}, lambda v: greatest(-99, least(99, round_even(round(v * 10, 9), 0)))::INT), ',') AS text FROM ms")
def series_serialize(spark, sf):
    """STR-19, MTH-03: quantised text of the normalised series (values first rounded to 9 digits)."""
    z = B.pool(spark, sf).select("sample_id", A.znorm(xs()).alias("z"))
    q = F.transform("z", lambda v: F.greatest(F.lit(-99.0), F.least(F.lit(99.0), F.rint(F.round(v * 10, 9)))).cast("int"))
    return z.select("sample_id", F.array_join(F.transform(q, lambda v: v.cast("string")), ",").alias("text"))


@query(f"""{_P}, {_MS}, q AS (SELECT sample_id, len(x) AS n, {_ZN} AS z FROM ms)
SELECT n, count(*) AS n_series, sum(len(list_filter(z, lambda v: abs(v) > 2)))::BIGINT AS n_clipped, sum(len(list_filter(z, lambda v: round_even(round(v * 10, 9), 0) = 0)))::BIGINT AS n_zero FROM q GROUP BY n""")
def clip_audit(spark, sf):
    """ARR-21, ARR-14: how many values hit the clip bound or quantise to zero."""
    q = B.pool(spark, sf).select(F.size("x").cast("long").alias("n"), A.znorm(xs()).alias("z"))
    return q.groupBy("n").agg(
        F.count("*").alias("n_series"),
        F.sum(F.size(F.filter("z", lambda v: F.abs(v) > 2))).cast("long").alias("n_clipped"),
        F.sum(F.size(F.filter("z", lambda v: F.rint(F.round(v * 10, 9)) == 0))).cast("long").alias("n_zero"),
    )


_RS = """list_transform(range(0, 9), lambda i: x[least(floor(i * (len(x) - 1) / 8.0), greatest(len(x) - 2, 0))::INT + 1] * (1 - (i * (len(x) - 1) / 8.0::DOUBLE - least(floor(i * (len(x) - 1) / 8.0), greatest(len(x) - 2, 0))))
  + coalesce(x[least(floor(i * (len(x) - 1) / 8.0), greatest(len(x) - 2, 0))::INT + 2], x[least(floor(i * (len(x) - 1) / 8.0), greatest(len(x) - 2, 0))::INT + 1]) * (i * (len(x) - 1) / 8.0::DOUBLE - least(floor(i * (len(x) - 1) / 8.0), greatest(len(x) - 2, 0))))"""


@query(f"{_P} SELECT sample_id, round(list_sum(list_transform({_RS}, lambda v, i: i * v)), 4) AS resized, round(list_sum(list_transform(range(0, 5), lambda i: (i + 1) * x[round_even(i * (len(x) - 1) / 4.0, 0)::INT + 1])), 4) AS decimated FROM pool")
def series_resize(spark, sf):
    """MTH-15: linear interpolation to 9 points and decimation to 5."""
    return B.pool(spark, sf).select(
        "sample_id",
        rounded(A.total(F.transform(A.resize(xs(), 9), lambda v, i: (i + 1) * v)), 4).alias("resized"),
        rounded(A.total(F.transform(A.decimate(xs(), 5), lambda v, i: (i + 1) * v)), 4).alias("decimated"),
    )


@query(f"""{_P}, t AS (SELECT sample_id, x, max(len(x)) OVER (PARTITION BY len(x) < 100) AS width FROM pool)
SELECT sample_id, width, width - len(x) AS padding, {_d("list_concat(x, list_transform(range(0, width - len(x)), lambda i: 0.0::DOUBLE))")} AS digest FROM t""")
def pad_mask(spark, sf):
    """SRC-19, ARR-16: padded to the longest of its bucket, with the mask's padding counted."""
    size = F.size("x")
    bucket = B.pool(spark, sf).withColumn("short", size < 100)
    width = bucket.groupBy("short").agg(F.max(F.size("x")).alias("width"))  # two rows
    t = bucket.join(F.broadcast(width), "short")
    return t.select(
        "sample_id",
        F.col("width").cast("long").alias("width"),
        F.size(F.filter(A.pad_mask(xs(), F.col("width")), lambda b: ~b)).cast("long").alias("padding"),
        A.digest(A.pad(xs(), F.col("width"))).alias("digest"),
    )


@query(f"""{_P} SELECT len(x) AS n, count(*) AS n_series, count(*) FILTER (list_max(x) = list_min(x)) AS n_constant, round(avg(len(list_distinct(x))), 6) AS mean_distinct,
  round(max(list_max(x) - list_min(x)), 6) AS widest FROM pool GROUP BY len(x)""")
def series_geometry(spark, sf):
    """ARR-14, GAT-10: constant series, distinct values and largest spread by length."""
    return B.pool(spark, sf).groupBy(F.size("x").cast("long").alias("n")).agg(
        F.count("*").alias("n_series"),
        F.count_if(A.spread(xs()) == 0).alias("n_constant"),
        rounded(F.avg(F.size(F.array_distinct("x"))), 6).alias("mean_distinct"),
        rounded(F.max(A.spread(xs())), 6).alias("widest"),
    )


@query(f"""{_P}, {_MS}, p AS (SELECT sample_id, len(x) AS n, m, list_max(x) AS hi, list_min(x) AS lo,
  list_max(list_transform(x, lambda v: abs(v - m))) AS far, s FROM ms)
SELECT sample_id, round(0 - m, 6) AS offset_value, round(CASE WHEN far >= 3 THEN far / 3 ELSE 1 END, 6) AS scale_value,
  'mean=' || round(m, 4)::VARCHAR IS NOT NULL AS has_text, n FROM p""")
def prefix_numbers(spark, sf):
    """STR-21: offset and scale of a series' numeric prefix."""
    far = A.bind(A.mean(xs()), lambda m: F.array_max(F.transform("x", lambda v: F.abs(v - m))))
    return B.pool(spark, sf).select(
        "sample_id",
        rounded(F.lit(0.0) - A.mean(xs()), 6).alias("offset_value"),
        rounded(F.when(far >= 3, far / 3).otherwise(1.0), 6).alias("scale_value"),
        A.mean(xs()).isNotNull().alias("has_text"),
        F.size("x").cast("long").alias("n"),
    )


_RND = "CAST(CAST(round({0} * 10000) AS BIGINT) // 10000 AS VARCHAR)"


@query(f"""{_P}, {_MS} SELECT sample_id, '[mean=' || CAST(round(m * 10000) AS BIGINT) || 'e-4|std=' || CAST(round(s * 10000) AS BIGINT) || 'e-4|min=' || CAST(round(list_min(x) * 10000) AS BIGINT)
  || 'e-4|max=' || CAST(round(list_max(x) * 10000) AS BIGINT) || 'e-4|length=' || len(x) || ']' AS summary FROM ms""")
def five_number_text(spark, sf):
    """STR-20: summary text; numbers as integers of 1e-4 so that engines agree on rounding."""
    part = lambda name, c: F.concat(F.lit(f"{name}="), F.round(c * 10000).cast("long").cast("string"), F.lit("e-4|"))
    return B.pool(spark, sf).select(
        "sample_id",
        F.concat(
            F.lit("["), part("mean", A.mean(xs())), part("std", A.pop_sd(xs())), part("min", F.array_min("x")), part("max", F.array_max("x")), F.lit("length="), F.size("x").cast("string"), F.lit("]")
        ).alias("summary"),
    )


@query("""SELECT caption_id, '42|' || pair_no AS k, ('0x' || substr(sha256(caption_id || '|sf_all|42'), 1, 12))::BIGINT AS seed,
  ('0x' || substr(sha256(caption_id), 1, 8))::BIGINT % 7 AS idx FROM pairs WHERE caption_id IS NOT NULL""")
def seed_derivation(spark, sf):
    """STR-27, STR-18: 48-bit seeds and hash indices."""
    return read_table(spark, sf, "pairs").where("caption_id is not null").select(
        "caption_id",
        F.concat(F.lit("42|"), F.col("pair_no").cast("string")).alias("k"),
        H.seed48(F.col("caption_id"), "sf_all", 42).alias("seed"),
        H.hash_index(F.col("caption_id"), 7).alias("idx"),
    )


@query(f"""{_P}, c AS (SELECT sample_id, x, unnest(['ex_half', 'reverse', 'unperturbed']) AS condition FROM pool)
SELECT condition, count(*) AS n, sum({_d("CASE condition WHEN 'ex_half' THEN list_concat(x[len(x) // 2 + 1 : len(x)], x[1 : len(x) // 2]) WHEN 'reverse' THEN list_reverse(x) ELSE x END")} % 1000003)::BIGINT AS digest FROM c GROUP BY condition""")
def condition_dispatch(spark, sf):
    """ARR-20, PRJ-11: condition list exploded to jobs, one transformed series each; order-free digest per condition."""
    jobs = B.pool(spark, sf).withColumn("condition", F.explode(F.array(*map(F.lit, ("ex_half", "reverse", "unperturbed")))))
    y = F.when(F.col("condition") == "ex_half", A.swap_halves(xs())).when(F.col("condition") == "reverse", F.reverse("x")).otherwise(xs())
    return jobs.withColumn("d", A.digest(y) % 1000003).groupBy("condition").agg(F.count("*").alias("n"), F.sum("d").alias("digest"))


@query(f"""{_P}, g AS (SELECT sample_id, x, md5(array_to_string(list_transform(x, lambda v: CAST(round(v * 1e6) AS BIGINT)), ',')) AS h FROM pool)
SELECT h, count(*) AS n, min(sample_id) AS first_id FROM g GROUP BY h HAVING count(*) > 1""")
def dup_series_groups(spark, sf):
    """AGG-12, MAP-04: samples with equal series, by content hash."""
    text = F.array_join(F.transform("x", lambda v: F.round(v * 1e6).cast("long").cast("string")), ",")
    g = B.pool(spark, sf).select("sample_id", F.md5(text).alias("h"))
    return g.groupBy("h").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id")).where("n > 1")


@query(f"""{_P}, l AS (SELECT sample_id, unnest(x) AS v, generate_subscripts(x, 1) AS p FROM pool),
m AS (SELECT sample_id, p, v, sum(v) OVER (PARTITION BY sample_id ORDER BY p ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) / 25 AS ma FROM l)
SELECT sample_id, round(max(ma), 6) AS top, round(min(ma), 6) AS bottom, round(avg(abs(v - ma)), 6) AS rough FROM m GROUP BY sample_id""")
def moving_average(spark, sf):
    """WIN-10: centred moving average with zero-padded edges: the window's sum over its nominal width, of every series."""
    from quillon.operators.features import moving_average as build

    return build(B.pool(spark, sf), "sample_id", "x", 25)


_FEAT = f"""{_P}, l AS (SELECT sample_id, len(x) AS n, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS p FROM pool WHERE len(x) >= 4 AND list_max(x) > list_min(x)),
a AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s FROM l WINDOW w AS (PARTITION BY sample_id)),
z AS (SELECT *, (v - m) / s AS z, 2.0::DOUBLE * p / (n - 1) - 1 AS u FROM a),
d AS (SELECT *, z - lag(z) OVER w AS dz, lead(z) OVER w AS nz FROM z WINDOW w AS (PARTITION BY sample_id ORDER BY p)),
e AS (SELECT *, sign(dz) AS sg, lag(sign(dz)) OVER (PARTITION BY sample_id ORDER BY p) AS psg FROM d),
mo AS (SELECT sample_id, avg(u * u) AS m2, avg(u * u * u * u) AS m4 FROM z GROUP BY sample_id)
SELECT e.sample_id, round(avg(z) FILTER (p < n // 3), 6) AS first_third, round(avg(z) FILTER (p >= n // 3 AND p < 2 * n // 3), 6) AS second_third, round(avg(z) FILTER (p >= 2 * n // 3), 6) AS last_third,
  round(2 * sum(z * u) / sum(u * u), 5) AS slope, round(4 * sum(z * (u * u - m2)) / sum((u * u - m2) * (u * u - m2)), 5) AS curvature,
  round(8 * sum(z * (u * u * u - m4 / m2 * u)) / sum((u * u * u - m4 / m2 * u) * (u * u * u - m4 / m2 * u)), 5) AS cubic,
  round(avg(power(z, 3)), 5) AS skew, round(avg(power(z, 4)), 5) AS kurtosis, round(max(abs(dz)), 6) AS biggest_jump,
  round(avg((abs(dz) > 1)::INT) FILTER (dz IS NOT NULL), 6) AS jump_rate, round(avg((sg <> psg)::INT) FILTER (psg IS NOT NULL), 6) AS reversal_rate,
  round(coalesce(corr(z, nz), 0), 5) AS lag1
FROM e JOIN mo USING (sample_id) GROUP BY e.sample_id"""


@query(_FEAT)
def series_features(spark, sf):
    """ARR-19, WIN-09/11/12/13, MTH-07/08: shape and texture features, one Arrow pass without a shuffle."""
    from quillon.operators.features import series_features as build

    return build(B.pool(spark, sf).where("size(x) >= 4"), "sample_id", "x")
