"""SQL (DuckDB) for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_CLEAN = "nullif(upper(regexp_replace(docid, '^\\s+|\\s+$', '', 'g')), '')"

_RECORDS = f"""r AS MATERIALIZED (
  SELECT DISTINCT row_index, queryid, {_CLEAN} AS d, split, source, array_to_string({_WORDS.format("query")}, ' ') AS q
  FROM train_with_negatives)"""

_P3 = f"""WITH {_RECORDS}, o AS (
  SELECT t.row_index AS tr, h.row_index AS hr, h.split, h.source
  FROM r t JOIN r h ON t.d = h.d
  WHERE t.split = 'train' AND h.split IN ('val', 'test') AND (t.queryid = h.queryid OR (t.q <> '' AND h.q <> '' AND (
    t.q = h.q OR list_sort(string_split(t.q, ' ')) = list_sort(string_split(h.q, ' '))
    OR levenshtein(t.q, h.q) <= least(3, greatest(length(t.q), length(h.q)) // 5)))))
"""

_COLLECTION = f"""c AS (SELECT docid, min(body) AS body FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY 1),
b AS (SELECT docid AS record_key, unnest({_WORDS.format("body")}) AS term FROM c),
bt AS (SELECT record_key, term, count(*) AS tf FROM b GROUP BY ALL),
s AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM bt GROUP BY 1),
n AS (SELECT sum(cf) AS total FROM s),
qt AS (SELECT CAST(row_index AS VARCHAR) AS record_key, row_number() OVER () AS i, unnest({_WORDS.format("query")}) AS term FROM train_with_negatives),
qn AS (SELECT record_key, i, term, count(*) AS tf FROM (SELECT x.record_key, x.i, x.term FROM qt x) GROUP BY ALL)"""

_VOCABULARY = f"""WITH c AS (SELECT docid, min(title) AS title, min(body) AS body FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY 1),
w AS (SELECT docid, unnest(list_concat(coalesce({_WORDS.format("title")}, []), coalesce({_WORDS.format("body")}, []))) AS term FROM c),
t AS (SELECT term, count(*) AS occurrences, count(DISTINCT docid) AS records FROM w GROUP BY 1)
SELECT term, occurrences, records,
  CASE WHEN records < 3 THEN 'rare' WHEN records > 0.25 * (SELECT count(*) FROM c) THEN 'common' ELSE 'kept' END AS mark FROM t"""

_NEAREST = """WITH v AS MATERIALIZED (
  SELECT vec_id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM doc_vectors
  WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY 1),
u AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))::DOUBLE[64] AS e FROM v),
p AS (SELECT a.vec_id, b.vec_id AS neighbour, round(array_inner_product(a.e, b.e), 6) AS similarity FROM u a JOIN u b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour) <= 10)
"""

_SETS = f"""c AS (SELECT docid, min(body) AS body FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY 1),
w AS (SELECT docid, {_WORDS.format("body")} AS w FROM c),
s AS MATERIALIZED (SELECT DISTINCT docid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS e FROM w WHERE len(w) >= 3),
n AS (SELECT docid, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.docid AS docid_a, y.docid AS docid_b, count(*) AS k FROM s x JOIN s y ON x.e = y.e AND x.docid < y.docid GROUP BY ALL)"""

_GROUPS = f"""WITH RECURSIVE {_RECORDS},
g AS MATERIALIZED (SELECT DISTINCT coalesce('q' || queryid, 'r' || row_index) AS q, d FROM r WHERE d IS NOT NULL),
e AS MATERIALIZED (SELECT DISTINCT x.d AS a, y.d AS b FROM g x JOIN (SELECT q, min(d) AS d FROM g GROUP BY 1) y ON x.q = y.q WHERE x.d <> y.d),
link AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(d, root) AS (SELECT d, d FROM (SELECT DISTINCT d FROM g) UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.d WHERE reach.root < link.b),
comp AS (SELECT d, min(root) AS c FROM reach GROUP BY 1),
qc AS (SELECT r.queryid, min(comp.c) AS c FROM r JOIN comp USING (d) GROUP BY 1),
k AS (SELECT DISTINCT r.row_index, coalesce(comp.c, qc.c) AS group_docid, coalesce('d' || coalesce(comp.c, qc.c), 'q' || r.queryid, 'r' || r.row_index) AS key
  FROM r LEFT JOIN comp ON r.d = comp.d LEFT JOIN qc ON r.queryid = qc.queryid)
SELECT row_index, group_docid FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1"""

_ORDER_COLS = {"bm25_score": 1, "bm25_score_title": 1, "body_length_norm": 1, "body_first_occurrence_mean": -1}


def _order() -> str:
    cols = list(_ORDER_COLS)
    finite = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in cols)
    cuts = ", ".join(f"quantile_disc({c}, 0.05) AS a{i}, quantile_disc({c}, 0.95) AS b{i}" for i, c in enumerate(cols))
    bounded = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN least(greatest({c}, a{i}), b{i}) END AS x{i}" for i, c in enumerate(cols))
    stats = ", ".join(f"nullif(sqrt(avg(x{i} * x{i})), 0) AS n{i}, {'max' if _ORDER_COLS[c] > 0 else 'min'}(x{i}) AS h{i}, {'min' if _ORDER_COLS[c] > 0 else 'max'}(x{i}) AS l{i}" for i, c in enumerate(cols))
    far = lambda to: "sqrt(" + " + ".join(f"coalesce((x{i} / n{i} - {to}{i} / n{i}) ** 2, ((h{i} - l{i}) / n{i} / 2) ** 2, 0)" for i in range(len(cols))) + ")"
    near = f"coalesce({far('l')} / nullif({far('h')} + {far('l')}, 0), 0.5)"
    return f"""WITH x AS (SELECT queryid, row_index, coalesce(source, '') AS u, {finite} FROM train_with_negatives),
c AS (SELECT u, {cuts} FROM x GROUP BY 1), w AS (SELECT queryid, row_index, u, {bounded} FROM x JOIN c USING (u)), s AS (SELECT u, {stats} FROM w GROUP BY 1)
SELECT queryid, row_index, row_number() OVER (PARTITION BY queryid ORDER BY round({near}, 9) DESC, row_index) AS place
FROM w JOIN s USING (u) WHERE queryid IS NOT NULL"""


_SCORES = f"""WITH {_COLLECTION},
a AS (SELECT 'body' AS field, record_key, term, tf, sum(tf) OVER (PARTITION BY record_key) AS len FROM bt
  UNION ALL SELECT 'query', record_key, term, tf, sum(tf) OVER (PARTITION BY record_key) FROM (SELECT record_key, term, count(*) AS tf FROM qt GROUP BY ALL)),
p AS (SELECT field, record_key, term, df, cf / total AS pc, (tf + 500.0 * (cf / total)) / (len + 500.0) AS pd FROM a JOIN s USING (term), n)
SELECT field, record_key, term, round(pd * ln(pd / pc), 6) + 0.0 AS score FROM p"""


_CLASSES = f"""{_SETS},
pr AS MATERIALIZED (SELECT docid_a, docid_b, k = x.n AND k = y.n AS same, k / (x.n + y.n - k) AS sim FROM common JOIN n x ON x.docid = docid_a JOIN n y ON y.docid = docid_b WHERE k / (x.n + y.n - k) >= 0.7),
cls AS MATERIALIZED (SELECT n.docid, coalesce(min(docid_a), n.docid) AS class_id FROM n LEFT JOIN pr ON docid_b = n.docid AND same GROUP BY n.docid),
size AS (SELECT class_id, count(*) AS size FROM cls GROUP BY 1),
link AS MATERIALIZED (SELECT DISTINCT a.class_id AS x, b.class_id AS y, sim FROM (SELECT docid_a, docid_b, sim FROM pr UNION ALL SELECT docid_b, docid_a, sim FROM pr) p
  JOIN cls a ON a.docid = p.docid_a JOIN cls b ON b.docid = p.docid_b WHERE a.class_id <> b.class_id)"""

_NEAR_GROUPS = f"""WITH RECURSIVE {_CLASSES},
reach(x, root) AS (SELECT class_id, class_id FROM size UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.x WHERE reach.root < link.y),
grp AS (SELECT x, min(root) AS group_id FROM reach GROUP BY 1), deg AS (SELECT x, count(*) AS links FROM link GROUP BY 1)
SELECT docid, class_id, group_id, coalesce(links, 0) AS links FROM cls JOIN grp ON grp.x = class_id LEFT JOIN deg ON deg.x = class_id"""

_NEAR_CLASSES = f"""WITH {_CLASSES}
SELECT x AS class_a, y AS class_b, a.size AS size_a, b.size AS size_b, round(sim, 6) AS similarity FROM link JOIN size a ON a.class_id = x JOIN size b ON b.class_id = y WHERE x < y
UNION ALL SELECT class_id, class_id, size, size, 1.0 FROM size WHERE size > 1"""

_OVERLAP_CLASSES = f"""WITH {_RECORDS}, t AS (SELECT DISTINCT row_index, d, queryid, q FROM r WHERE split = 'train'), h AS (SELECT DISTINCT row_index, d, queryid, q FROM r WHERE split IN ('val', 'test')),
ti AS (SELECT d, CAST(queryid AS VARCHAR) AS k, count(*) AS n FROM t WHERE d IS NOT NULL AND queryid IS NOT NULL GROUP BY ALL), hi AS (SELECT d, CAST(queryid AS VARCHAR) AS k, count(*) AS n FROM h WHERE d IS NOT NULL AND queryid IS NOT NULL GROUP BY ALL),
tt AS (SELECT d, q AS k, count(*) AS n FROM t WHERE d IS NOT NULL AND q <> '' GROUP BY ALL), ht AS (SELECT d, q AS k, count(*) AS n FROM h WHERE d IS NOT NULL AND q <> '' GROUP BY ALL)
SELECT d AS docid, 'id' AS kind, k AS train_key, k AS held_key, ti.n AS train_records, hi.n AS held_records FROM ti JOIN hi USING (d, k)
UNION ALL SELECT tt.d, CASE WHEN tt.k = ht.k THEN 'text' ELSE 'near' END, tt.k, ht.k, tt.n, ht.n FROM tt JOIN ht ON tt.d = ht.d
WHERE tt.k = ht.k OR list_sort(string_split(tt.k, ' ')) = list_sort(string_split(ht.k, ' ')) OR levenshtein(tt.k, ht.k) <= least(3, greatest(length(tt.k), length(ht.k)) // 5)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _GROUPS,
        "p1_balance": "SELECT DISTINCT split_name, true AS near, CAST(0 AS BIGINT) AS groups_apart FROM split_plan",
        "p2_order": _order(),
        "p3_found": _P3 + "SELECT DISTINCT least(tr, hr) AS row_index_a, greatest(tr, hr) AS row_index_b FROM o",
        "p3_counts": _P3 + "SELECT split, source, count(DISTINCT hr) AS records, count(DISTINCT (tr, hr)) AS pairs FROM o GROUP BY 1, 2",
        "p3_classes": _OVERLAP_CLASSES,
        "p4_found": f"WITH {_COLLECTION} SELECT 'body' AS field, record_key, term FROM bt JOIN s USING (term) WHERE tf >= 3 AND df <= 3 UNION SELECT 'query', record_key, term FROM qt JOIN s USING (term) WHERE df <= 3",
        "p4_scores": _SCORES,
        "p4_shared": f"{_SCORES} WHERE df >= 3",
        "p5_found": f"SELECT term, mark FROM ({_VOCABULARY}) WHERE mark <> 'kept'",
        "p5_terms": _VOCABULARY,
        "p6_found": _NEAREST + "SELECT DISTINCT least(vec_id, neighbour) AS vec_id_a, greatest(vec_id, neighbour) AS vec_id_b FROM k",
        "p6_nearest": _NEAREST + "SELECT vec_id, neighbour, similarity FROM k",
        "p7_found": f"WITH {_SETS} SELECT docid_a, docid_b FROM common JOIN n x ON x.docid = docid_a JOIN n y ON y.docid = docid_b WHERE k / (x.n + y.n - k) >= 0.7",
        "p7_groups": _NEAR_GROUPS,
        "p7_classes": _NEAR_CLASSES,
        "p9_fill": "SELECT count(*) AS texts, CAST(0 AS BIGINT) AS tokens_lost, CAST(0 AS BIGINT) AS cut_in_vain, CAST(0 AS BIGINT) AS overfull, true AS \"full\" FROM documents WHERE text <> ''",
    }
