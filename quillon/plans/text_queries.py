"""Text grammar, rule classification and dates over captions, items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import dates as D
from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.functions.arrays import bind
from quillon.functions.numbers import rounded
from quillon.plans.registry import query
from quillon.session import read_table

_SENT = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
_WORDS = r"len(list_filter(string_split_regex(trim({0}, ' '), '\s+'), lambda w: w <> ''))"
_LIST = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
_RE = lambda p: "'" + p.replace("'", "''") + "'"


def cap():
    return F.col("caption")


def captions(spark, sf):
    return read_table(spark, sf, "pairs").where("caption is not null")


@query(f"SELECT pair_no, len({_SENT.format('caption')}) AS n_sentences, ({_SENT.format('caption')})[1] AS first_sentence FROM pairs WHERE caption IS NOT NULL")
def sentence_split(spark, sf):
    """STR-01."""
    s = T.sentences(cap())
    return captions(spark, sf).select("pair_no", F.size(s).cast("long").alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"))


_FL = "trim(lower(split_part(class_label, ';', 1)), ' ')"


@query(f"""WITH c AS (SELECT pair_no, {_FL} AS f, {_SENT.format('caption')} AS s FROM pairs WHERE caption IS NOT NULL AND class_label IS NOT NULL)
SELECT pair_no, CASE WHEN len(s) >= 2 AND f <> 'clean' THEN len(s) - 1 ELSE len(s) END AS n_shape, CASE WHEN len(s) >= 2 AND f <> 'clean' THEN s[len(s)] END AS fluctuation_clause FROM c""")
def clause_split(spark, sf):
    """STR-02, PRJ-02: last sentence to the fluctuation unless clean."""
    fluctuation = F.trim(F.lower(F.split_part("class_label", F.lit(";"), F.lit(1))))
    shape, last = T.clauses(cap(), fluctuation)
    return captions(spark, sf).where("class_label is not null").select("pair_no", F.size(shape).cast("long").alias("n_shape"), last.alias("fluctuation_clause"))


@query(f"""SELECT component, probe_condition, round(avg(CASE WHEN c > d THEN 1 WHEN c = d THEN 0.5 ELSE 0 END), 6) AS pick_longer, round(avg(c - d), 6) AS mean_delta, round(avg(abs(c - d)), 6) AS mean_abs_delta, count(*) AS n
  FROM (SELECT component, probe_condition, {_WORDS.format('caption_correct')} AS c, {_WORDS.format('caption_distractor')} AS d FROM probe1_items WHERE caption_distractor IS NOT NULL) GROUP BY ALL""")
def word_balance(spark, sf):
    """STR-03, STR-04: length deltas and the always-pick-the-longer baseline."""
    c, d = T.word_count(F.col("caption_correct")), T.word_count(F.col("caption_distractor"))
    i = read_table(spark, sf, "probe1_items").where("caption_distractor is not null").select("component", "probe_condition", c.alias("c"), d.alias("d"))
    longer = F.when(F.col("c") > F.col("d"), 1.0).when(F.col("c") == F.col("d"), 0.5).otherwise(0.0)
    delta = F.col("c") - F.col("d")
    return i.groupBy("component", "probe_condition").agg(
        rounded(F.avg(longer), 6).alias("pick_longer"), rounded(F.avg(delta), 6).alias("mean_delta"), rounded(F.avg(F.abs(delta)), 6).alias("mean_abs_delta"), F.count("*").alias("n")
    )


@query(f"""WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(caption), '[a-z'']+'))) AS w FROM pairs WHERE caption IS NOT NULL)
SELECT w AS word, count(*) AS n_captions FROM w WHERE NOT list_contains({_LIST(V.STOP_WORDS)}, w) GROUP BY w ORDER BY n_captions DESC, w LIMIT 25""")
def word_docfreq(spark, sf):
    """STR-05, STR-15, AGG-16, SRT-03: captions containing each word, the 25 most frequent."""
    w = captions(spark, sf).select(F.explode(T.content_words(cap())).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n_captions")).orderBy(F.desc("n_captions"), "word").limit(25)


def docfreq(spark, sf, patterns):
    hits = captions(spark, sf).select(F.explode(T.matched(cap(), patterns)).alias("pattern"))
    return hits.groupBy("pattern").agg(F.count("*").alias("n_captions"))


@query("\nUNION ALL ".join(f"SELECT {_RE(p)} AS pattern, count(*) AS n_captions FROM pairs WHERE regexp_matches(caption, {_RE(V.either([p]))}) HAVING count(*) > 0" for p in V.ORDER_CLAIMS))
def pattern_docfreq(spark, sf):
    """STR-06, AGG-16: captions containing each pattern of the whole family of order claims."""
    return docfreq(spark, sf, V.ORDER_CLAIMS)


_ID, _OC, _AN, _NM, _ST = (_RE(p) for p in (V.either(V.IDIOMS), V.either(V.ORDER_CLAIMS), V.either(V.ANCHORS), V.NEGATED_MOTION, V.either(V.STRAIGHT)))
_RULE = f"""WITH c AS (SELECT pair_no, caption AS t, regexp_matches(caption, {_NM}) AS neg FROM pairs WHERE caption IS NOT NULL),
m AS (SELECT *, regexp_matches(CASE WHEN neg THEN regexp_replace(regexp_replace(t, {_NM}, ' ', 'g'), {_ID}, ' ', 'g') ELSE regexp_replace(t, {_ID}, ' ', 'g') END, {_OC}) AS claim FROM c),
r AS (SELECT pair_no, CASE WHEN length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) < 3 THEN 'junk' WHEN claim THEN 'order_claim' WHEN neg THEN 'negated_motion'
  WHEN regexp_matches(t, {_ID}) THEN 'idiom' WHEN regexp_matches(t, {_AN}) THEN 'anchored' WHEN regexp_matches(t, {_ST}) THEN 'straight_alone' ELSE 'no_anchor' END AS reason FROM m)"""


@query(f"{_RULE} SELECT pair_no, CASE reason WHEN 'order_claim' THEN 'dependent' WHEN 'negated_motion' THEN 'invariant' WHEN 'anchored' THEN 'invariant' ELSE 'ambiguous' END AS label, reason FROM r")
def rule_classify(spark, sf):
    """TXT-01, STR-07, STR-08: three-way priority classifier of captions."""
    return captions(spark, sf).select("pair_no", T.order_label(cap()).alias("r")).select("pair_no", "r.label", "r.reason")


@query(f"{_RULE} SELECT dataset, reason, count(*) AS n FROM r JOIN pairs USING (pair_no) GROUP BY ALL")
def rule_census(spark, sf):
    """TXT-01 counted by dataset, AGG-01."""
    return captions(spark, sf).select("dataset", T.order_label(cap())["reason"].alias("reason")).groupBy("dataset", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT pair_no, {_FL} AS f, trim(lower(split_part(class_label, ';', 2)), ' ') AS s FROM pairs WHERE class_label IS NOT NULL)
SELECT pair_no, CASE WHEN f NOT IN ({", ".join(map(repr, V.FLUCTUATION_VERDICT))}) THEN 'unknown' WHEN f = 'clean' AND s = 'constant' THEN 'degenerate'
  WHEN s <> 'constant' OR f IN ('smooth', 'step') THEN 'dependent' ELSE 'invariant' END AS verdict FROM l""")
def class_verdict(spark, sf):
    """TXT-02: verdict from the label's two atoms, by a dimension join."""
    table = spark.createDataFrame(list(V.FLUCTUATION_VERDICT.items()), "f string, v string")  # seven rows
    label = read_table(spark, sf, "pairs").where("class_label is not null").select(
        "pair_no", F.trim(F.lower(F.split_part("class_label", F.lit(";"), F.lit(1)))).alias("f"), F.trim(F.lower(F.split_part("class_label", F.lit(";"), F.lit(2)))).alias("s")
    )
    free = F.col("s").isin(V.ORDER_FREE_SHAPES)
    verdict = F.when(F.col("v").isNull(), "unknown").when((F.col("f") == "clean") & free, "degenerate").when(~free | (F.col("v") == "dependent"), "dependent").otherwise("invariant")
    return label.join(F.broadcast(table), "f", "left").select("pair_no", verdict.alias("verdict"))


_ND, _NA = _RE(V.NARRATIVE_ORDERED), _RE(V.either(V.NARRATIVE_AMBIGUOUS))


@query(f"""WITH s AS (SELECT doc_id, {_SENT.format('text')} AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN len(list_filter(s, lambda x: regexp_matches(x, {_ND}))) > 0 THEN 'dependent' WHEN len(list_filter(s, lambda x: regexp_matches(x, {_NA}))) > 0 THEN 'ambiguous' ELSE 'invariant' END AS bucket FROM s""")
def description_bucket(spark, sf):
    """TXT-03: bucket of a description from its sentences."""
    return read_table(spark, sf, "documents").where("text is not null").select("doc_id", T.description_bucket(F.col("text")).alias("bucket"))


_POS, _NEG = _RE(r"(?i)\b(?:rises?|climbs?|grows?|jumps?|leaps?|lifts?|surges?)\b"), _RE(r"(?i)\b(?:falls?|drops?|sinks?|dives?|plunges?|sags?|slides?)\b")


@query(f"""WITH f AS (UNPIVOT (SELECT item_id, caption_correct, caption_distractor, clause_replaced_from, clause_replaced_to FROM probe1_items) ON caption_correct, caption_distractor, clause_replaced_from, clause_replaced_to INTO NAME field VALUE t)
SELECT field, CASE WHEN p AND n THEN 'both' WHEN p THEN 'positive' WHEN n THEN 'negative' ELSE 'neither' END AS polarity, count(*) AS n_items FROM (SELECT field, regexp_matches(t, {_POS}) AS p, regexp_matches(t, {_NEG}) AS n FROM f WHERE t IS NOT NULL) GROUP BY ALL""")
def phrase_polarity(spark, sf):
    """TXT-04: coverage of two phrase polarities per field."""
    fields = ["caption_correct", "caption_distractor", "clause_replaced_from", "clause_replaced_to"]
    long = read_table(spark, sf, "probe1_items").select("item_id", *fields).unpivot("item_id", fields, "field", "t").where("t is not null")
    p, n = F.regexp_like("t", F.lit(_POS[1:-1])), F.regexp_like("t", F.lit(_NEG[1:-1]))
    polarity = F.when(p & n, "both").when(p, "positive").when(n, "negative").otherwise("neither")
    return long.groupBy("field", polarity.alias("polarity")).agg(F.count("*").alias("n_items"))


_R1, _R2, _R3 = _RE(r"(?i)\b(?:indicat\w+|suggest\w+|peak\w*|trough\w*)\b"), _RE(r"-?\d+(?:\.\d+)?[^0-9]+-?\d+(?:\.\d+)?"), _RE(r"(?i)\b(?:rising|falling|rises|falls|rose|fell)\b")


@query(f"""WITH f AS (SELECT item_id, list_filter([CASE WHEN regexp_matches(clause_replaced_to, {_R1}) THEN 'R1' END, CASE WHEN regexp_matches(clause_replaced_to, {_R2}) THEN 'R2' END,
  CASE WHEN regexp_matches(replace(caption_distractor, clause_replaced_to, ' '), {_R3}) THEN 'R3' END], lambda x: x IS NOT NULL) AS flags FROM probe1_items WHERE probe_condition = 'swap' AND clause_replaced_to IS NOT NULL AND caption_distractor IS NOT NULL)
SELECT item_id, array_to_string(flags, '+') AS flags, len(flags) AS n_flags FROM f""")
def screen_flags(spark, sf):
    """TXT-05, STR-11: screening rules on the swapped clause and on the rest of the caption."""
    i = read_table(spark, sf, "probe1_items").where("probe_condition = 'swap' and clause_replaced_to is not null and caption_distractor is not null")
    rest = F.replace("caption_distractor", "clause_replaced_to", F.lit(" "))
    clause = F.col("clause_replaced_to")
    flags = F.array_compact(F.array(F.when(F.regexp_like(clause, F.lit(_R1[1:-1])), "R1"), F.when(F.regexp_like(clause, F.lit(_R2[1:-1])), "R2"), F.when(F.regexp_like(rest, F.lit(_R3[1:-1])), "R3")))
    return i.select("item_id", F.array_join(flags, "+").alias("flags"), F.size(flags).cast("long").alias("n_flags"))


def _first_sql(stems):
    return f"list_min(list_filter(list_transform({_LIST(stems)}, lambda w: instr(lower(caption), w)), lambda i: i > 0))"


def _score_sql(stems):
    return " + ".join(f"((length(lower(caption)) - length(replace(lower(caption), '{w}', ''))) // {len(w)})" for w in stems)


@query(f"""SELECT pair_no, CASE WHEN u IS NULL AND d IS NULL THEN 'none' WHEN d IS NULL OR u < d THEN 'up' ELSE 'down' END AS direction, score FROM
  (SELECT pair_no, {_first_sql(V.UP_STEMS)} AS u, {_first_sql(V.DOWN_STEMS)} AS d, ({_score_sql(V.UP_STEMS)}) - ({_score_sql(V.DOWN_STEMS)}) AS score FROM pairs WHERE caption IS NOT NULL)""")
def first_direction(spark, sf):
    """STR-09, STR-10: first direction stem and net stem count."""
    return captions(spark, sf).select("pair_no", T.first_direction(cap()).alias("direction"), T.stem_score(cap()).cast("long").alias("score"))


@query(r"""SELECT pair_no, trim(regexp_replace(regexp_replace(caption, '[A-Z][A-Za-z.]*(?: County)?(?:,? [A-Z][A-Za-z.]*)*', '<PLACE>', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS frame FROM pairs WHERE caption IS NOT NULL""")
def frame_extract(spark, sf):
    """STR-14."""
    return captions(spark, sf).select("pair_no", T.frame(cap()).alias("frame"))


@query(r"""SELECT pair_no, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(caption, '\bRis', chr(1), 'g'), '\bris', chr(2), 'g'), '\bFall', chr(3), 'g'), '\bfall', chr(4), 'g'),
  chr(1), 'Fall'), chr(2), 'fall'), chr(3), 'Ris'), chr(4), 'ris') AS swapped FROM pairs WHERE caption IS NOT NULL""")
def stem_swap(spark, sf):
    """STR-13: stems swapped both ways with their suffixes."""
    return captions(spark, sf).select("pair_no", T.swap_stems(cap(), "ris", "fall").alias("swapped"))


_MAP = {"first": "last", "last": "first", "left": "right", "right": "left", "smooth": "noisy", "noisy": "smooth"}
_MAPSQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in _MAP.items()) + "}"


@query(f"""SELECT pair_no, array_to_string(list_transform(regexp_extract_all(caption, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda p: CASE WHEN m[lower(p)] IS NULL THEN p
  WHEN upper(p[1]) = p[1] AND lower(p[1]) <> p[1] THEN upper(m[lower(p)][1]) || m[lower(p)][2:] ELSE m[lower(p)] END), '') AS swapped FROM (SELECT pair_no, caption, {_MAPSQL} AS m FROM pairs WHERE caption IS NOT NULL)""")
def word_swap(spark, sf):
    """STR-12, MAP-03: simultaneous whole-word substitution with an inverse map."""
    return captions(spark, sf).select("pair_no", T.swap_words(cap(), _MAP).alias("swapped"))


@query("""SELECT idx, CASE WHEN instr(caption_correct, clause_replaced_from) > 0 THEN substr(caption_correct, 1, instr(caption_correct, clause_replaced_from) - 1) || clause_replaced_to || substr(caption_correct, instr(caption_correct, clause_replaced_from) + length(clause_replaced_from)) ELSE caption_correct END AS rebuilt,
  coalesce(CASE WHEN instr(caption_correct, clause_replaced_from) > 0 THEN substr(caption_correct, 1, instr(caption_correct, clause_replaced_from) - 1) || clause_replaced_to || substr(caption_correct, instr(caption_correct, clause_replaced_from) + length(clause_replaced_from)) ELSE caption_correct END = caption_distractor, false) AS same
  FROM manual_validation_sample WHERE clause_replaced_from IS NOT NULL AND clause_replaced_to IS NOT NULL AND caption_correct IS NOT NULL""")
def clause_rebuild(spark, sf):
    """STR-11, JON-19: first-occurrence replacement with a reconstruction check."""
    m = read_table(spark, sf, "manual_validation_sample").where("clause_replaced_from is not null and clause_replaced_to is not null and caption_correct is not null")
    rebuilt = T.replace_first(F.col("caption_correct"), F.col("clause_replaced_from"), F.col("clause_replaced_to"))
    return m.select("idx", rebuilt.alias("rebuilt"), F.coalesce(rebuilt == F.col("caption_distractor"), F.lit(False)).alias("same"))


@query("""SELECT idx, len(list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) AS n_differing,
  CASE WHEN a <> b THEN list_filter(range(1, greatest(length(a), length(b)) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1] END AS first_difference
  FROM (SELECT idx, trim(regexp_replace(caption_correct, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS a, trim(regexp_replace(caption_distractor, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS b FROM manual_validation_sample WHERE caption_correct IS NOT NULL AND caption_distractor IS NOT NULL)""".replace("\\\\", "\\"))
def text_difference(spark, sf):
    """STR-17: first differing character after squeezing white space."""
    m = read_table(spark, sf, "manual_validation_sample").where("caption_correct is not null and caption_distractor is not null")
    a, b = T.squeeze(F.col("caption_correct")), T.squeeze(F.col("caption_distractor"))

    def differing(p):
        n = F.greatest(F.length(p["a"]), F.length(p["b"]))
        return F.size(F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(p["a"], i, F.lit(1)) != F.substring(p["b"], i, F.lit(1))))

    return m.select("idx", bind(F.struct(a.alias("a"), b.alias("b")), differing).cast("long").alias("n_differing"), T.first_difference(a, b).cast("long").alias("first_difference"))


_PIN = "CASE swap_to " + " ".join(f"WHEN '{k}' THEN " + " AND ".join(f"contains(lower(clause_replaced_to), '{w}')" for w in ws) for k, ws in V.PINNING_WORDS.items()) + " END"


@query(f"SELECT item_id, coalesce(({_PIN})::VARCHAR, 'no rule') AS pinned FROM probe1_items WHERE clause_replaced_to IS NOT NULL AND slot = 'fluct'")
def pins_target(spark, sf):
    """STR-16: does the clause name its target value."""
    i = read_table(spark, sf, "probe1_items").where("clause_replaced_to is not null and slot = 'fluct'")
    return i.select("item_id", F.coalesce(T.pins(F.col("clause_replaced_to"), F.col("swap_to")).cast("string"), F.lit("no rule")).alias("pinned"))


@query(r"""SELECT doc_id, greatest(1, length(text) // 4) AS tokens, regexp_matches(text, '[^\x00-\x7F]') AS non_ascii, instr(text, chr(65533)) > 0 AS mojibake,
  len(list_filter(['prompt', 'swap', 'distractor'], lambda t: instr(lower(text), t) > 0)) AS n_forbidden, trim(text) = '' AS blank FROM documents WHERE text IS NOT NULL""")
def text_canaries(spark, sf):
    """STR-22, FLT-08, FLT-11, FLT-12: token estimate, non-ASCII and mojibake canaries, forbidden tokens, blanks."""
    t = F.col("text")
    forbidden = F.filter(F.array(*map(F.lit, ("prompt", "swap", "distractor"))), lambda w: F.instr(F.lower(t), w) > 0)
    return read_table(spark, sf, "documents").where("text is not null").select(
        "doc_id", T.token_estimate(t).cast("long").alias("tokens"), F.regexp_like(t, F.lit(r"[^\x00-\x7F]")).alias("non_ascii"), (F.instr(t, "�") > 0).alias("mojibake"),
        F.size(forbidden).cast("long").alias("n_forbidden"), (F.trim(t) == "").alias("blank"),
    )


@query("""WITH t AS (SELECT pair_no, list_transform(string_split(replace(replace(class_label, '{', ''), '}', ''), ';'), lambda x: lower(trim(x, ' '))) AS tokens FROM pairs WHERE class_label IS NOT NULL)
SELECT pair_no, array_to_string(list_sort(tokens), '|') AS tokens, len(list_filter(['noisy', 'linear rise'], lambda x: NOT list_contains(tokens, x))) = 0 AS has_pair, sha256(array_to_string(list_sort(tokens), '|'))[1:12] AS short_hash FROM t""")
def label_tokens(spark, sf):
    """STR-23, SET-06, STR-18: label sets and the subset test."""
    bare = F.replace(F.replace("class_label", F.lit("{"), F.lit("")), F.lit("}"), F.lit(""))
    tokens = F.transform(F.split(bare, ";"), lambda x: F.lower(F.trim(x)))
    t = read_table(spark, sf, "pairs").where("class_label is not null").select("pair_no", tokens.alias("tokens"))
    joined = F.array_join(F.array_sort("tokens"), "|")
    return t.select("pair_no", joined.alias("tokens"), (F.size(F.array_except(F.array(F.lit("noisy"), F.lit("linear rise")), "tokens")) == 0).alias("has_pair"), F.substring(F.sha2(joined, 256), 1, 12).alias("short_hash"))


_ML = "[" + ", ".join(f"'{m}'" for m in V.MONTHS) + "]"


@query(f"""WITH o AS (SELECT o_orderkey, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, year(o_orderdate)::INT AS y FROM orders),
s AS (SELECT *, ((m - 7 + 12) % 12) + 1 AS sm, y + CASE WHEN m - 7 < 0 THEN -1 ELSE 0 END AS sy, ((m - 2 + 12) % 12) + 1 AS pm FROM o)
SELECT o_orderkey, 'The past six months from ' || {_ML}[sm] || ' ' || d || ', ' || sy || ' to ' || {_ML}[m] || ' ' || d || ', ' || y || '.' AS six_months,
  'The past week from ' || CASE WHEN d > 7 THEN {_ML}[m] || ' ' || (d - 7) ELSE {_ML}[pm] || ' ' || ([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][pm] + d - 7) END || ' to ' || {_ML}[m] || ' ' || d || ', ' || y || '.' AS week,
  m AS month, d AS day, y AS year, 'week' AS duration FROM s""")
def period_slots(spark, sf):
    """DAT-01 to DAT-05: period sentences from order dates, then parsed back from their text."""
    o = read_table(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), F.year("o_orderdate").alias("y"))
    m, d, y = F.col("m"), F.col("d"), F.col("y")
    o = o.select("o_orderkey", D.period_slot(m, d, y, True).alias("six_months"), D.period_slot(m, d, y, False).alias("week"))
    start, end = D.from_to(F.col("week"))
    parsed = D.partial_date(end, start)
    return o.select("o_orderkey", "six_months", "week", parsed["month"].alias("month"), parsed["day"].alias("day"), parsed["year"].alias("year"), D.duration_class(F.col("week")).alias("duration"))


@query("""SELECT part.p_partkey, upper(p_brand[1]) || lower(p_brand[2:]) AS brand, 'The ' || lower(p_type) || ' part ' || p_name || ' has size ' || p_size || '.' AS description,
  'p=' || CASE WHEN p = 0 THEN '<1e-300' ELSE CAST(round(p / power(10.0, floor(log10(p))) * 1000) AS BIGINT) || 'e' || (floor(log10(p)) - 3)::BIGINT END AS p_text FROM (SELECT *, 1.0::DOUBLE / (p_partkey * 7 + 3) AS p FROM part) part""")
def row_template(spark, sf):
    """PRJ-15, STR-24, STR-26: row template, capitalised recognition, p-value text."""
    p = read_table(spark, sf, "part")
    text = F.concat(F.lit("The "), F.lower("p_type"), F.lit(" part "), F.col("p_name"), F.lit(" has size "), F.col("p_size").cast("string"), F.lit("."))
    return p.select(
        "p_partkey", F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lower(F.expr("substring(p_brand, 2)"))).alias("brand"), text.alias("description"), F.concat(F.lit("p="), T.p_text(1.0 / (F.col("p_partkey") * 7 + 3))).alias("p_text")
    )
