"""The same results as plain SQL for DuckDB: direct comparisons over whole tables, without any candidate search."""

from __future__ import annotations


def _words(text: str) -> str:
    return rf"regexp_extract_all(regexp_replace(lower({text}), '[\x{{00AD}}\x{{200B}}-\x{{200D}}\x{{FEFF}}]', '', 'g'), '[\p{{L}}\p{{N}}]+')"


_P1 = f"""
r AS (SELECT pair_no, split, dataset, series, {_words('caption')} AS ws FROM pairs
      WHERE split IN ('train', 'val', 'test') AND series IS NOT NULL AND caption IS NOT NULL
        AND len(list_filter(series, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        AND len(series) > 0 AND list_max(series) > list_min(series)),
z AS (SELECT pair_no, split, dataset, len(ws) AS n,
             list_transform(series, lambda x: (x - list_avg(series)) / list_stddev_pop(series)) AS z FROM r WHERE len(ws) > 0),
tok AS (SELECT pair_no, w, row_number() OVER (PARTITION BY pair_no, w) AS k FROM (SELECT pair_no, unnest(ws) AS w FROM r)),
near AS (SELECT e.pair_no AS ev, t.pair_no AS tr, e.n AS en, t.n AS tn FROM z e JOIN z t ON len(e.z) = len(t.z)
         WHERE e.split <> 'train' AND t.split = 'train' AND abs(e.z[1] - t.z[1]) <= 0.05
           AND list_max(list_transform(list_zip(e.z, t.z), lambda x: abs(x[1] - x[2]))) <= 0.05),
hits AS (SELECT ev, tr, en, tn, count(*) AS c FROM near JOIN tok a ON a.pair_no = ev JOIN tok b ON b.pair_no = tr AND a.w = b.w AND a.k = b.k
         GROUP BY ALL),
found AS (SELECT * FROM hits WHERE 10 * c >= 6 * (en + tn - c))"""

_P2 = f"""
WITH rec AS (SELECT 'p' || pair_no AS rec, caption AS t FROM pairs UNION ALL
             SELECT 'm' || idx, caption_distractor FROM manual_validation_sample),
w AS (SELECT rec, {_words('t')} AS ws FROM rec WHERE t IS NOT NULL),
big AS (SELECT rec, len(ws) AS n, ws FROM w WHERE len(ws) >= 20),
tok AS (SELECT rec, n, w, row_number() OVER (PARTITION BY rec, w) AS k FROM (SELECT rec, n, unnest(ws) AS w FROM big))
SELECT rec_a, rec_b FROM (
  SELECT a.rec AS rec_a, b.rec AS rec_b, a.n AS na, b.n AS nb, count(*) AS c
  FROM tok a JOIN tok b ON a.w = b.w AND a.k = b.k AND a.rec < b.rec GROUP BY ALL)
WHERE 10 * c >= 8 * (na + nb - c)"""

_P3 = """
WITH ok AS (SELECT line_id, line_text::JSON AS j FROM (SELECT * FROM pair_lines WHERE json_valid(line_text)) WHERE json_type(line_text) = 'OBJECT'),
k AS (SELECT line_id, min(line_id) OVER w AS keep_id, count(*) OVER w AS n_copies FROM (
  SELECT line_id, array_to_string(regexp_extract_all(lower(j->>'caption'), '[\\p{L}\\p{N}]+'), '') AS cap, j->>'dataset' AS d, j->>'split' AS s,
         j->>'sample_id' AS sid, j->>'caption_id' AS cid, CAST(j->'series' AS DOUBLE[]) AS ser, j->>'class_label' AS lab FROM ok)
  WINDOW w AS (PARTITION BY cap, d, s, sid, cid, ser, lab))"""

_NAME = "trim(lower(replace({0}, '\\', '/')), chr(32) || chr(9) || chr(13) || chr(10) || chr(160))"

_P4 = f"""
WITH RECURSIVE r AS (SELECT pair_no, split, {_NAME.format('sample_id')} AS s,
        CASE WHEN instr(caption_id, '#') > 0 THEN {_NAME.format("regexp_replace(caption_id, '#[^#]*$', '')")} END AS c FROM pairs),
e AS (SELECT DISTINCT s AS a, c AS b FROM r WHERE s <> c UNION SELECT DISTINCT c, s FROM r WHERE s <> c),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
g AS (SELECT pair_no, split, coalesce(root, s, c) AS g FROM r LEFT JOIN root ON root.a = coalesce(s, c) WHERE coalesce(s, c) IS NOT NULL)
SELECT pair_no FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(DISTINCT split) > 1)"""


def _p5(cutoffs: list[str]) -> str:
    name, cap = _NAME.format("sample_id"), _NAME.format("regexp_replace(caption_id, '#[^#]*$', '')")
    out = [
        f"""WITH k0 AS (SELECT concat_ws('|', coalesce({name}, CASE WHEN instr(caption_id, '#') > 0 THEN {cap} END, ''), {_NAME.format('caption_id')}) AS key,
        coalesce(trim(dataset), '') AS dataset, loaded_at, pair_no FROM pairs WHERE caption_id IS NOT NULL),
k AS (SELECT key, min(dataset) AS stratum, min(loaded_at) AS seen, min(pair_no) AS keep_no, count(*) AS n_rows, md5('s1|' || key) AS priority FROM k0 GROUP BY key),
l0 AS (SELECT stratum, key, priority, 0 AS step FROM k WHERE false)"""
    ]
    for i, cut in enumerate([*cutoffs, None]):
        when = f"seen < TIMESTAMP '{cut}'" if cut else "true"
        out.append(
            f"""q{i} AS (SELECT stratum, (count(*) * 100 + 999) // 1000 AS quota FROM k WHERE {when} GROUP BY stratum),
h{i} AS (SELECT stratum, count(*) AS held FROM l{i} GROUP BY stratum),
n{i} AS (SELECT stratum, key, priority, row_number() OVER (PARTITION BY stratum ORDER BY priority, key) AS nth FROM k WHERE {when} AND key NOT IN (SELECT key FROM l{i})),
l{i + 1} AS (SELECT * FROM l{i} UNION ALL SELECT n.stratum, key, priority, {i} FROM n{i} n JOIN q{i} q ON n.stratum = q.stratum
        LEFT JOIN h{i} h ON n.stratum = h.stratum WHERE nth <= quota - coalesce(held, 0))"""
        )
    last = len(cutoffs) + 1
    return ",\n".join(out) + f"\nSELECT l.stratum, l.key, l.priority, l.step, k.keep_no, k.n_rows FROM l{last} l JOIN k ON l.key = k.key"


_P7 = f"""
WITH i AS (SELECT eval_id, {_words('text')} AS ws FROM eval_items WHERE text IS NOT NULL),
d AS (SELECT doc_id, {_words('text')} AS ws FROM documents WHERE text IS NOT NULL),
iw AS (SELECT eval_id, least(12, len(ws)) AS n, array_to_string(ws[s : s + least(12, len(ws)) - 1], ' ') AS g
       FROM (SELECT eval_id, ws, unnest(range(1, len(ws) - least(12, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, array_to_string(ws[s : s + n - 1], ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n))
SELECT DISTINCT doc_id, eval_id FROM dw JOIN iw USING (n, g)"""

_P8 = """
WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, s, 300)) AS h
           FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS s FROM documents WHERE length(text) >= 300))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id"""


_P8_STARTS = """
WITH w AS (SELECT doc_id, s, md5(substr(text, s, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS s FROM documents WHERE length(text) >= 300)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)),
st AS (SELECT doc_id, s, lag(s) OVER o AS before, lead(s) OVER o AS after FROM w WHERE h IN (SELECT h FROM g) WINDOW o AS (PARTITION BY doc_id ORDER BY s))"""


def oracle(cutoffs: list[str]) -> dict[str, str]:
    return {
        "p1_found": f"WITH {_P1} SELECT least(ev, tr) AS pair_a, greatest(ev, tr) AS pair_b FROM found",
        "p1_overlap_by_split": f"""WITH {_P1},
            best AS (SELECT ev, count(*) AS c, max(c / en) AS best FROM found GROUP BY ev)
            SELECT split, dataset, count(*) AS n_rows, count(best) AS n_leaked, coalesce(sum(c), 0)::BIGINT AS n_pairs,
                   round(avg(best), 6) AS mean_containment
            FROM pairs LEFT JOIN best ON ev = pair_no WHERE split IN ('val', 'test') GROUP BY split, dataset""",
        "p2_found": _P2,
        "p2_groups": f"""WITH RECURSIVE pairs_found AS ({_P2}),
            same AS (SELECT rec, array_to_string(list_sort({_words('t')}), ' ') AS ws FROM (SELECT 'p' || pair_no AS rec, caption AS t FROM pairs UNION ALL
                     SELECT 'm' || idx, caption_distractor FROM manual_validation_sample)),
            e AS (SELECT rec_a AS a, rec_b AS b FROM pairs_found UNION SELECT rec_b, rec_a FROM pairs_found),
            reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
            g AS (SELECT a AS rec, min(b) AS group_id FROM reach GROUP BY a),
            l AS (SELECT e.a, count(DISTINCT y.ws) AS n_links FROM e JOIN same x ON x.rec = e.a JOIN same y ON y.rec = e.b WHERE x.ws <> y.ws GROUP BY e.a),
            c AS (SELECT ws, count(*) AS n_copies FROM same GROUP BY ws)
            SELECT g.rec, group_id, coalesce(n_links, 0) AS n_links, n_copies FROM g JOIN same USING (rec) JOIN c USING (ws) LEFT JOIN l ON l.a = g.rec""",
        "p3_found": f"{_P3} SELECT keep_id, line_id AS copy_id FROM k WHERE line_id <> keep_id",
        "p3_records": f"{_P3} SELECT keep_id, n_copies FROM k WHERE line_id = keep_id",
        "p4_found": _P4,
        "p5_sample": _p5(cutoffs),
        "p7_found": _P7,
        "p4_check": "SELECT count(*) AS n_rows, 0::BIGINT AS n_torn, true AS near FROM pairs",
        "p6_check": """SELECT spec_id, (SELECT count(*) FROM documents WHERE text <> '') AS n_texts, 0::BIGINT AS n_cut, 0::BIGINT AS n_over, true AS well_filled
            FROM pack_spec WHERE capacity_tokens > 0""",
        "p8_found": _P8,
        "p8_shared": f"""{_P8_STARTS}, c AS (SELECT doc_id, sum(coalesce(least(after - s, 300), 300))::BIGINT AS shared FROM st GROUP BY doc_id)
            SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(shared, 0) AS shared_chars, CASE WHEN shared IS NULL THEN 0 ELSE round(shared / length(text), 6) END AS share
            FROM documents LEFT JOIN c USING (doc_id)""",
        "p8_stretches": f"""{_P8_STARTS}, i AS (SELECT doc_id, s, sum((before IS NULL OR s - before > 300)::INT) OVER (PARTITION BY doc_id ORDER BY s) AS nth FROM st)
            SELECT doc_id, min(s) - 1 AS start, max(s) + 299 AS end FROM i GROUP BY doc_id, nth""",
    }
