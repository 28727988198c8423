"""DuckDB SQL for the queries of rankloom.queries."""

from __future__ import annotations

from rankloom.functions.scoring import B, IDF_THRESHOLD, K1, TITLE_WEIGHT
from rankloom.operators.ltr import DEV_RANKS, NEAR_RANKS, TRAIN_RANKS
from rankloom.operators.search import FEATURES
from rankloom.queries import LAYERS, SHAPES

_TOKENS = r"coalesce(regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\s\p{{L}}\p{{M}}\p{{N}}_]'), [])"

_DOCS = f"""docs AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY docid) - 1 AS doc_id, * FROM (
    SELECT docid, min((coalesce(url, ''), coalesce(title, ''), coalesce(body, ''))) AS x FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY 1)),
tok AS MATERIALIZED (SELECT doc_id, docid, x[1] AS url, x[2] AS title, x[3] AS body, {_TOKENS.format("x[2]")} AS tt, {_TOKENS.format("x[3]")} AS bt FROM docs),
occ AS (SELECT doc_id, 0 AS field, unnest(tt) AS term, generate_subscripts(tt, 1) - 1 AS pos FROM tok
  UNION ALL SELECT doc_id, 1, unnest(bt), generate_subscripts(bt, 1) - 1 FROM tok)"""
_POST = f"""{_DOCS}, post AS MATERIALIZED (
  SELECT term, doc_id, count(*) FILTER (field = 0) AS tf_title, count(*) FILTER (field = 1) AS tf_body,
    min(pos) FILTER (field = 0) AS first_title, min(pos) FILTER (field = 1) AS first_body FROM occ GROUP BY ALL),
terms AS MATERIALIZED (SELECT term, count(*) AS df FROM post GROUP BY 1),
len AS MATERIALIZED (SELECT doc_id, len(tt) AS title_len, len(bt) AS body_len FROM tok),
st AS MATERIALIZED (SELECT count(*) AS n, avg(body_len) AS avg_body, avg(title_len) AS avg_title, max(body_len) AS max_body, max(title_len) AS max_title FROM len),
idf AS MATERIALIZED (SELECT term, df, ln((n - df + 0.5) / (df + 0.5)) AS idf FROM terms, st)"""
_BATCH = f"""batch AS (SELECT queryid AS qid, min(query) AS query FROM train_queries WHERE queryid % 50 = 0 AND query IS NOT NULL GROUP BY 1),
ql AS MATERIALIZED (SELECT qid, unnest({_TOKENS.format("query")}) AS term, generate_subscripts({_TOKENS.format("query")}, 1) AS leaf FROM batch)"""
_ALL = _BATCH.replace("queryid % 50 = 0 AND ", "")


def _flat(c: str) -> str:
    return rf"""regexp_replace(coalesce({c}, ''), '[\t\r\n"\\]', ' ', 'g')"""


def _kept(threshold: bool = True) -> str:
    """kept(qid, leaf, term, idf): the words that are asked for."""
    where = f" WHERE idf IS NULL OR idf >= {IDF_THRESHOLD}" if threshold else ""
    return f"kept AS MATERIALIZED (SELECT qid, leaf, ql.term, idf FROM ql LEFT JOIN idf USING (term){where}), nk AS (SELECT qid, count(*) AS k FROM kept GROUP BY 1)"


_W = lambda f: f"coalesce(tf_{f} / ({1 - B} + {B} * (cast({f}_len AS DOUBLE) / nullif(avg_{f}, 0))), 0)"
_S = lambda w: f"idf * (({w}) * {K1 + 1}) / (({w}) + {K1})"
_BOTH = f"{_W('body')} + {TITLE_WEIGHT} * {_W('title')}"
_HITS = f"""hits AS MATERIALIZED (
  SELECT qid, doc_id, count(DISTINCT leaf) AS got, sum({_S(_BOTH)}) AS bm25_score, sum({_S(_W("body"))}) AS bm25_score_body, sum({_S(_W("title"))}) AS bm25_score_title,
    (sum(coalesce(first_body / body_len, 1.0)) + any_value(k) - count(*)) / any_value(k) AS body_first_occurrence_mean,
    (sum(coalesce(first_title / title_len, 1.0)) + any_value(k) - count(*)) / any_value(k) AS title_first_occurrence_mean,
    min(coalesce(first_body / body_len, 1.0)) AS body_first_occurrence_min, min(coalesce(first_title / title_len, 1.0)) AS title_first_occurrence_min,
    any_value(body_len / max_body) AS body_length_norm, any_value(title_len / max_title) AS title_length_norm,
    CAST(min(coalesce(first_title / title_len, 1.0)) < 1.0 AS INT) AS in_title, any_value(k) AS k
  FROM kept JOIN nk USING (qid) JOIN post USING (term) JOIN len USING (doc_id), st GROUP BY qid, doc_id)"""
_OR = f"WITH {_POST}, {_BATCH}, {_kept()}, {_HITS}"
_OR_ALL = f"WITH {_POST}, {_ALL}, {_kept()}, {_HITS}"


def _top(score: str) -> str:
    return f"top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({score}, 9) DESC, doc_id) AS rank FROM hits QUALIFY rank <= 100)"


_ROUNDED = ", ".join(f"round({f} + 1e-9, 6) AS {f}" for f in FEATURES[:-1])
# the first 100 bytes; a character cut in two becomes U+FFFD
_CUT = "list_max(list_filter(range(0, 101), lambda i: strlen(body[1:i]) <= 100))"
_SNIPPET = f"CASE WHEN strlen(body) = length(body) THEN body[1:100] ELSE body[1:{_CUT}] || CASE WHEN strlen(body[1:{_CUT}]) < 100 AND length(body) > {_CUT} THEN chr(65533) ELSE '' END END"
_PHRASES = rf"""pb AS (SELECT try_cast(docid[2:] AS BIGINT) AS qid, min(tt[1:2]) AS t FROM tok WHERE try_cast(docid[2:] AS BIGINT) % 50 = 0 AND len(tt[1:2]) = 2 GROUP BY 1),
ph AS (SELECT DISTINCT qid, a.doc_id FROM pb JOIN occ a ON a.term = t[1] JOIN occ b ON b.term = t[2] AND b.doc_id = a.doc_id AND b.field = a.field AND b.pos = a.pos + 1),
kept AS (SELECT qid, leaf, p.term, idf FROM (SELECT qid, unnest([1, 2]) AS leaf, unnest(t) AS term FROM pb) p JOIN idf USING (term)), nk AS (SELECT qid, count(*) AS k FROM kept GROUP BY 1)"""
_BOOLEAN = r"""bb AS (SELECT qid, string_split(trim(regexp_replace(lower(query), '\s+', ' ', 'g')), ' ') AS w FROM batch),
bq AS (SELECT qid, w FROM bb WHERE len(w) >= 3 AND NOT list_has_any(w, ['and', 'or', 'not']) AND regexp_full_match(w[1], '[a-z0-9]+') AND regexp_full_match(w[2], '[a-z0-9]+') AND regexp_full_match(w[3], '[a-z0-9]+')),
kept AS (SELECT qid, leaf, b.term, idf FROM (SELECT qid, unnest([1, 2, 3]) AS leaf, unnest(w[1:3]) AS term FROM bq) b JOIN idf USING (term)), nk AS (SELECT qid, 3 AS k FROM bq),
flags AS (SELECT qid, doc_id, bool_or(leaf = 1) OR bool_or(leaf = 2) AS yes, bool_or(leaf = 3) AS no FROM kept JOIN post USING (term) GROUP BY ALL)"""
_GRAMS = lambda t: f"list_distinct(list_transform(range(1, len({t}) + 1), lambda i: ('$' || {t} || '$')[i:i + 2]))"
_SPELL = f"""mis AS (SELECT DISTINCT x[:-2] AS word FROM (SELECT unnest(string_split(regexp_replace(lower(query), '\\s+', ' ', 'g'), ' ')) AS x FROM batch) WHERE regexp_full_match(x, '[a-z]+') AND len(x) > 5),
dict AS MATERIALIZED (SELECT unnest({_GRAMS("term")}) AS trigram, term, len({_GRAMS("term")}) AS n FROM (SELECT DISTINCT term FROM occ WHERE field = 1)),
mg AS (SELECT word, unnest({_GRAMS("word")}) AS trigram, len({_GRAMS("word")}) AS nw FROM mis),
jac AS (SELECT word, term, count(*) / (any_value(n) + any_value(nw) - count(*)) AS jaccard FROM mg JOIN dict USING (trigram) GROUP BY ALL),
cand AS MATERIALIZED (SELECT * FROM jac QUALIFY row_number() OVER (PARTITION BY word ORDER BY jaccard DESC, term) <= 75)"""
_RUN = "(SELECT *, rank_no AS rank FROM top100_run)"
_PAIRS = "(SELECT DISTINCT queryid, docid, rel FROM train_qrels WHERE docid IS NOT NULL)"
_NEG = "neg AS (SELECT row_index AS idx, match_rank, " + "unnest([" + ", ".join(map(str, TRAIN_RANKS)) + "]) AS neg_rank, unnest([" + ", ".join(f"neg_{r}" for r in TRAIN_RANKS) + "]) AS neg_docid FROM train_with_negatives)"
_LISTS = """WITH r AS (SELECT queryid, row_index, rel, bm25_score AS score FROM train_with_negatives WHERE queryid IS NOT NULL AND bm25_score IS NOT NULL AND NOT isnan(bm25_score)),
pos AS (SELECT queryid, min(row_index) AS pos FROM r WHERE rel >= 1 GROUP BY 1),
lists AS (SELECT queryid, row_index, score, CAST(row_index = pos AS INT) AS label FROM r JOIN pos USING (queryid))"""
_VEC = """v AS MATERIALIZED (SELECT vec_id, any_value(docid) AS docid, any_value(CAST(embedding AS DOUBLE[])) AS e FROM doc_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 64
  AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) GROUP BY 1),
u AS MATERIALIZED (SELECT vec_id, docid, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v)"""
_EMB = "u AS MATERIALIZED (SELECT vec_id, label, e, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS w FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"
_CENT = "cent AS MATERIALIZED (SELECT label AS cluster, i, avg(x) AS x FROM (SELECT label, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM u) GROUP BY ALL), cv AS MATERIALIZED (SELECT cluster, list(x ORDER BY i) AS c FROM cent GROUP BY 1)"
_NEAR = "near AS MATERIALIZED (SELECT a.vec_id AS qid, cluster, list_distance(a.e, c) AS distance FROM u a, cv WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(distance, 9), cluster) <= 5)"
_COS = "row_number() OVER (PARTITION BY qid ORDER BY round(similarity, 9) DESC, {id}) AS rank"
_EXACT = f"ex AS (SELECT *, {_COS.format(id='vec_id')} FROM (SELECT a.vec_id AS qid, b.vec_id, round(list_inner_product(a.w, b.w), 9) AS similarity FROM u a, u b WHERE a.vec_id % 50 = 0) QUALIFY rank <= 100)"


def _network(source: str, keys: str) -> tuple[str, str]:
    """CTEs that end in a table with the keys and the network's score of the features in source; and its last name."""
    x = [f"coalesce(CASE WHEN NOT isnan({f}) THEN {f} END, 0)" if f != "in_title" else "coalesce(in_title, 0)" for f in FEATURES]
    ctes = []
    for i, (w, b) in enumerate(LAYERS):
        out = [" + ".join([str(bias), *(f"({c} * {v})" for c, v in zip(row, x))]) for row, bias in zip(w, b)]
        if i + 1 < len(LAYERS):
            out = [f"greatest({o}, 0)" for o in out]
        ctes.append(f"l{i} AS (SELECT {keys}, " + ", ".join(f"{o} AS h{i}_{j}" for j, o in enumerate(out)) + f" FROM {source})")
        x, source = [f"h{i}_{j}" for j in range(len(out))], f"l{i}"
    return ", ".join(ctes), f"(SELECT {keys}, {x[0]} AS score FROM {source})"


def _mlp() -> str:
    ctes, table = _network("train_with_negatives", "row_index")
    return f'WITH {ctes} SELECT row_index AS "index", round(score, 6) AS score FROM {table}'


def _reranked() -> str:
    ctes, table = _network("top", "qid, doc_id")
    return f"""{_OR}, {_top("bm25_score")}, {ctes}
SELECT qid, rank, round(score, 6) AS score, docid FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {table} QUALIFY rank <= 10) JOIN tok USING (doc_id)"""


def _semantic() -> str:
    """CTEs: feat(qid, doc_id, similarity, features) of the hundred nearest documents of each query's stated vector."""
    lexical = [f"coalesce({f}, {v}) AS {f}" for f, v in zip(FEATURES[:7], (0, 0, 0, 1.0, 1.0, 1.0, 1.0))]
    return f"""WITH {_POST}, {_BATCH}, {_kept(False)}, {_HITS}, {_VEC},
dv AS MATERIALIZED (SELECT doc_id, arg_min(u.e, vec_id) AS e FROM u JOIN docs USING (docid) GROUP BY 1),
qi AS (SELECT qid, row_number() OVER (ORDER BY qid) AS i FROM batch), di AS (SELECT e, row_number() OVER (ORDER BY doc_id) AS i FROM dv),
near AS MATERIALIZED (SELECT *, {_COS.format(id='doc_id')} FROM (SELECT qid, dv.doc_id, round(list_inner_product(di.e, dv.e), 9) AS similarity FROM qi JOIN di USING (i), dv) QUALIFY rank <= 100),
feat AS MATERIALIZED (SELECT n.qid, n.doc_id, n.similarity, {", ".join(lexical)}, len.body_len / max_body AS body_length_norm, len.title_len / max_title AS title_length_norm, coalesce(in_title, 0) AS in_title
  FROM near n LEFT JOIN hits h ON h.qid = n.qid AND h.doc_id = n.doc_id LEFT JOIN len ON len.doc_id = n.doc_id, st)"""


def _semantic_search() -> str:
    ctes, table = _network("feat", "qid, doc_id, similarity")
    scaled = lambda c: f"({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w + 1e-8)"
    return f"""{_semantic()}, {ctes}, fu AS (SELECT qid, doc_id, {scaled("similarity")} + exp({scaled("score")}) - 1 AS fused FROM {table} WINDOW w AS (PARTITION BY qid))
SELECT qid, rank, round(fused, 5) AS score, docid, (SELECT count(*) FROM dv) AS num_results
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(fused, 9) DESC, doc_id) AS rank FROM fu QUALIFY rank <= 10) JOIN docs USING (doc_id)"""


def _shapes() -> str:
    a, b, c = (f"h{i}" for i in (1, 2, 3))
    holds = [f"{a} AND {b}", f"{a} AND {b}", f"{a} AND ({b} OR {c})", f"NOT {a} AND {b}", f"p12 OR {c}", f"({a} OR {b}) AND NOT {c}", f"{a} OR {b} AND {c}", f"{a} AND {b}", f"{c} AND NOT p12", "p123"]
    assert len(holds) == len(SHAPES)
    rows = " UNION ALL ".join(f"SELECT qid * {len(holds)} + {i} AS qid, doc_id FROM fl WHERE {h}" for i, h in enumerate(holds))
    return rf"""WITH {_POST}, {_ALL}, {_BOOLEAN.split("kept AS")[0].rstrip().rstrip(",")}, w3 AS (SELECT qid, unnest([1, 2, 3]) AS leaf, unnest(w[1:3]) AS term FROM bq),
pos AS MATERIALIZED (SELECT qid, leaf, doc_id, field, pos FROM w3 JOIN occ USING (term)),
ph2 AS (SELECT DISTINCT x.qid, x.doc_id FROM pos x JOIN pos y ON y.qid = x.qid AND y.doc_id = x.doc_id AND y.field = x.field AND y.pos = x.pos + 1 AND x.leaf = 1 AND y.leaf = 2),
ph3 AS (SELECT DISTINCT x.qid, x.doc_id FROM pos x JOIN pos y ON y.qid = x.qid AND y.doc_id = x.doc_id AND y.field = x.field AND y.pos = x.pos + 1 AND x.leaf = 1 AND y.leaf = 2
  JOIN pos z ON z.qid = x.qid AND z.doc_id = x.doc_id AND z.field = x.field AND z.pos = x.pos + 2 AND z.leaf = 3),
hs AS (SELECT qid, doc_id, bool_or(leaf = 1) AS h1, bool_or(leaf = 2) AS h2, bool_or(leaf = 3) AS h3 FROM pos GROUP BY ALL),
fl AS MATERIALIZED (SELECT hs.*, ph2.qid IS NOT NULL AS p12, ph3.qid IS NOT NULL AS p123 FROM hs LEFT JOIN ph2 ON ph2.qid = hs.qid AND ph2.doc_id = hs.doc_id LEFT JOIN ph3 ON ph3.qid = hs.qid AND ph3.doc_id = hs.doc_id)
{rows}"""


def _offline() -> str:
    score = lambda w: f"sum(CASE WHEN coalesce(idf, 0) <> 0 THEN {_S(w)} ELSE 0 END)"
    return f"""WITH {_POST}, prs AS (SELECT row_number() OVER () AS r, row_index AS idx, query, doc_id, title_len, body_len FROM train_with_negatives JOIN docs USING (docid) JOIN len USING (doc_id)),
m AS (SELECT max(title_len) AS mt, max(body_len) AS mb FROM prs),
w AS (SELECT r, idx, doc_id, title_len, body_len, unnest({_TOKENS.format("query")}) AS term FROM prs),
x AS (SELECT r, title_len, body_len, coalesce(tf_title, 0) AS tf_title, coalesce(tf_body, 0) AS tf_body, coalesce(first_title / title_len, 1.0) AS ft, coalesce(first_body / body_len, 1.0) AS fb, idf
  FROM w LEFT JOIN post USING (doc_id, term) LEFT JOIN idf USING (term)),
g AS (SELECT r, {score(_BOTH)} AS s, {score(_W("body"))} AS sb, {score(_W("title"))} AS st, avg(fb) AS fbm, avg(ft) AS ftm, min(fb) AS fbn, min(ft) AS ftn FROM x, st GROUP BY r)
SELECT idx AS "index", round(coalesce(s, 0) + 1e-9, 6) AS bm25_score, round(coalesce(sb, 0) + 1e-9, 6) AS bm25_score_body, round(coalesce(st, 0) + 1e-9, 6) AS bm25_score_title, round(coalesce(fbm, 1) + 1e-9, 6) AS body_first_occurrence_mean,
  round(coalesce(ftm, 1) + 1e-9, 6) AS title_first_occurrence_mean, round(coalesce(fbn, 1) + 1e-9, 6) AS body_first_occurrence_min, round(coalesce(ftn, 1) + 1e-9, 6) AS title_first_occurrence_min,
  round(body_len / mb + 1e-9, 6) AS body_length_norm, round(title_len / mt + 1e-9, 6) AS title_length_norm, CAST(coalesce(ftn, 1) < 1.0 AS INT) AS in_title FROM prs LEFT JOIN g USING (r), m"""


def oracle_sql() -> dict[str, str]:
    near, far = NEAR_RANKS[:5], TRAIN_RANKS[-5:]
    picked = f"""CASE WHEN coalesce(try_cast(match_rank AS INT), 0) = 0 THEN neg_rank IN ({", ".join(map(str, near + far))})
 WHEN try_cast(match_rank AS INT) <= 6 THEN (neg_rank <= 6 AND neg_rank <> try_cast(match_rank AS INT)) OR neg_rank > 95
 ELSE neg_rank <= 5 OR (neg_rank > 94 AND neg_rank <> try_cast(match_rank AS INT)) END"""
    soft = "exp({0}) / sum(exp({0})) OVER w"
    return {
        "tokenize_stats": f"WITH {_DOCS} SELECT doc_id, len(tt) AS n_title, len(bt) AS n_body, len(list_distinct(bt)) AS n_distinct FROM tok",
        "postings_build": f"""WITH {_DOCS} SELECT term, doc_id, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (field = 0), '') AS pos_title,
 coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (field = 1), '') AS pos_body, count(*) FILTER (field = 0) AS tf_title, count(*) FILTER (field = 1) AS tf_body FROM occ GROUP BY term, doc_id""",
        "doc_lengths": f"WITH {_POST} SELECT * FROM len",
        "corpus_stats": f"WITH {_POST} SELECT n, round(avg_body, 6) AS avg_body, round(avg_title, 6) AS avg_title, max_body, max_title FROM st",
        "doc_freq": f"WITH {_POST} SELECT * FROM terms",
        "idf_terms": f"WITH {_POST} SELECT term, df, round(idf, 6) AS idf FROM idf",
        "stop_terms": f"WITH {_POST} SELECT term, df FROM idf WHERE idf < {IDF_THRESHOLD}",
        "trigram_dictionary": f"WITH {_POST}, {_BATCH}, {_SPELL} SELECT trigram, term, n FROM dict",
        "match_and": f"{_OR} SELECT qid, doc_id FROM hits WHERE got = k",
        "match_or": f"{_OR} SELECT qid, doc_id FROM hits",
        "match_not": f"{_OR_ALL} SELECT q.qid, len.doc_id, 0.0::DOUBLE AS score FROM (SELECT DISTINCT qid FROM ql) q, len WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.qid = q.qid AND h.doc_id = len.doc_id)",
        "match_phrase": f"WITH {_POST}, {_PHRASES}, {_HITS} SELECT qid, doc_id, round(bm25_score, 6) AS score FROM ph JOIN hits USING (qid, doc_id)",
        "match_boolean_nested": f"WITH {_POST}, {_BATCH}, {_BOOLEAN}, {_HITS} SELECT qid, doc_id, round(bm25_score, 6) AS score FROM flags JOIN hits USING (qid, doc_id) WHERE yes AND NOT no",
        "bm25_fielded_topk": f"{_OR}, {_top('bm25_score')} SELECT qid, doc_id, rank, round(bm25_score, 6) AS score FROM top",
        "bm25_body_topk": f"{_OR}, {_top('bm25_score_body')} SELECT qid, doc_id, rank, round(bm25_score_body, 6) AS score FROM top",
        "bm25_title_topk": f"{_OR}, {_top('bm25_score_title')} SELECT qid, doc_id, rank, round(bm25_score_title, 6) AS score FROM top",
        "total_hits": f"{_OR} SELECT qid, count(*) AS num_results FROM hits GROUP BY 1",
        "features_topk": f"{_OR}, {_top('bm25_score')} SELECT qid, doc_id, {_ROUNDED}, in_title FROM top",
        "search_results": f"""{_OR}, {_top('bm25_score')}, tot AS (SELECT qid, count(*) AS num_results FROM hits GROUP BY 1)
SELECT qid, rank, round(bm25_score, 6) AS score, docid, title, {_SNIPPET} AS body_snippet, num_results FROM top JOIN tok USING (doc_id) JOIN tot USING (qid) WHERE rank <= 10""",
        "spelling_candidates": f"WITH {_POST}, {_BATCH}, {_SPELL} SELECT word, term, round(jaccard, 6) AS jaccard FROM cand",
        "spelling_corrections": f"""WITH {_POST}, {_BATCH}, {_SPELL}, e AS (SELECT *, levenshtein(word, term) AS edits FROM cand),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, jaccard DESC, term) <= 50)
SELECT word, term AS correction, df, edits FROM n JOIN terms USING (term) QUALIFY row_number() OVER (PARTITION BY word ORDER BY df DESC, term) = 1""",
        "qrels_join": f"WITH {_DOCS} SELECT queryid, docid, rel, query, x[2] AS title FROM train_qrels JOIN docs USING (docid) JOIN train_queries USING (queryid)",
        "run_filter_ranks": "SELECT queryid, docid, rank_no AS rank FROM top100_run WHERE rank_no <= 6 OR rank_no > 94",
        "run_pivot": "SELECT queryid, " + ", ".join(f"min(docid) FILTER (rank_no = {r}) AS neg_{r}" for r in DEV_RANKS) + " FROM top100_run GROUP BY 1",
        "match_rank_case": f"""WITH one AS (SELECT queryid, rank, min(docid) AS docid FROM {_RUN} WHERE rank BETWEEN 1 AND 100 GROUP BY ALL), q AS (SELECT DISTINCT queryid FROM one WHERE queryid IS NOT NULL),
m AS (SELECT queryid, docid, min(rank) AS r FROM one GROUP BY ALL)
SELECT p.queryid, p.docid, p.rel, m.r AS match FROM {_PAIRS} p JOIN q USING (queryid) LEFT JOIN m ON m.queryid = p.queryid AND m.docid = p.docid""",
        "row_index": f'SELECT row_number() OVER (ORDER BY queryid, docid) - 1 AS "index", queryid, docid, rel FROM (SELECT queryid, docid, max(rel) AS rel FROM {_PAIRS} WHERE rel IS NOT NULL AND queryid IS NOT NULL GROUP BY ALL)',
        "negatives_long": f'WITH {_DOCS}, {_NEG} SELECT idx AS "index", neg_rank, neg_docid, x[2] AS neg_title, length(x[3]) AS n_chars FROM neg JOIN docs ON docid = neg_docid',
        "negative_selection": f'WITH {_NEG} SELECT idx AS "index", neg_rank, neg_docid FROM neg WHERE neg_docid IS NOT NULL AND ({picked})',
        "wide_join": f'WITH {_DOCS}, {_NEG}, l AS (SELECT idx, neg_rank, length(x[3]) AS chars FROM neg JOIN docs ON docid = neg_docid), g AS (SELECT idx, '
        + ", ".join(f"max(chars) FILTER (neg_rank = {r}) AS chars_{r}" for r in TRAIN_RANKS)
        + ' FROM l GROUP BY 1) SELECT row_index AS "index", docid, g.* EXCLUDE (idx) FROM train_with_negatives JOIN g ON idx = row_index',
        "null_fill_norms": 'SELECT row_index AS "index", round(coalesce(body_length_norm, 0), 6) AS body_length_norm, round(coalesce(title_length_norm, 0), 6) AS title_length_norm FROM train_with_negatives',
        "split_sizes": """WITH o AS (SELECT row_index, row_number() OVER (ORDER BY md5(row_index || '-42'), row_index) - 1 AS i, count(*) OVER () AS n FROM train_with_negatives)
SELECT CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split, count(*) AS n, sum(row_index) AS sum_index FROM o GROUP BY 1""",
        "offline_features": _offline(),
        "ranking_metrics": f"""{_LISTS}, p AS (SELECT queryid, max(score) AS p FROM lists WHERE label = 1 GROUP BY 1), rk AS (SELECT queryid, 1 + count(*) FILTER (score > p AND label <> 1) AS rank FROM lists JOIN p USING (queryid) GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg FROM rk""",
        "listwise_loss": f"""{_LISTS}, z AS (SELECT queryid, label, score - max(score) OVER (PARTITION BY queryid) AS s FROM lists), a AS (SELECT queryid, label, {soft.format("s")} AS p FROM z WINDOW w AS (PARTITION BY queryid)), b AS (SELECT queryid, label, {soft.format("p")} AS q FROM a WINDOW w AS (PARTITION BY queryid))
SELECT queryid, round(sum(-ln(q)), 6) AS loss FROM b WHERE label = 1 GROUP BY 1""",
        "mlp_forward": _mlp(),
        "reranked_results": _reranked(),
        "snippets": f"WITH {_DOCS} SELECT docid, {_SNIPPET} AS body_snippet FROM tok",
        "semantic_lexical_join": f"{_semantic()} SELECT qid, doc_id, round(similarity, 6) AS similarity, {_ROUNDED}, in_title FROM feat",
        "semantic_search": _semantic_search(),
        "kmeans_sizes": "SELECT count(*) AS n, true AS close FROM embeddings",
        "scan_corpus": f"SELECT docid, {_flat('url')} AS url, {_flat('title')} AS title, length({_flat('body')}) AS n_chars FROM msmarco_docs WHERE docid IS NOT NULL",
        "scan_queries": f"SELECT queryid, {_flat('query')} AS query FROM train_queries WHERE query IS NOT NULL",
        "scan_qrels": "SELECT queryid, dummy, docid, rel FROM train_qrels",
        "scan_run": "SELECT queryid, docid, rank_no AS rank, round(score, 6) AS score, algorithm FROM top100_run",
        "files_by_rank": f'WITH {_NEG} SELECT neg_rank, idx AS "index", neg_docid FROM neg WHERE neg_docid IS NOT NULL',
        "files_by_split": """WITH o AS (SELECT row_index, row_number() OVER (ORDER BY md5(row_index || '-42'), row_index) - 1 AS i, count(*) OVER () AS n FROM train_with_negatives)
SELECT row_index AS "index", CASE WHEN i < floor(n * 0.8) THEN 'train' WHEN i < floor(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM o""",
        "index_verified": f"WITH {_POST} SELECT (SELECT count(*) FROM post) AS postings, (SELECT count(*) FROM terms) AS terms, true AS agrees",
        "first_rows": "SELECT least(100, count(*)) AS n FROM msmarco_docs WHERE docid IS NOT NULL",
        "dataset_items": 'SELECT row_index AS "index", CAST(coalesce(rel, 0) >= 1 AS INT) AS label, unnest(range(10)) AS i, round(unnest([' + ", ".join(f"coalesce(CASE WHEN NOT isnan(CAST({f} AS DOUBLE)) THEN CAST({f} AS DOUBLE) END, 0)" for f in FEATURES) + "]), 6) AS x FROM train_with_negatives",
        "item_batches": """SELECT row_index AS "index", (row_number() OVER (ORDER BY md5(row_index || '-7'), row_index) - 1) // 64 AS batch FROM train_with_negatives""",
        "dev_negatives": f"""WITH one AS (SELECT queryid, rank AS neg_rank, min(docid) AS neg_docid FROM {_RUN} WHERE rank BETWEEN 1 AND 100 GROUP BY ALL)
SELECT queryid, p.docid, neg_rank, neg_docid FROM (SELECT queryid, docid FROM {_PAIRS}) p JOIN one USING (queryid) WHERE neg_docid IS NOT NULL""",
        "bm25_classic": f"WITH {_POST}, {_BATCH}, {_kept()} SELECT qid, doc_id, round(sum(idf * tf_body * {K1 + 1} / (tf_body + {K1} * ({1 - B} + {B} * body_len / avg_body))), 6) AS score FROM kept JOIN post USING (term) JOIN len USING (doc_id), st WHERE tf_body > 0 GROUP BY 1, 2",
        "spelled_search": f"""WITH {_POST}, {_BATCH}, {_SPELL}, e AS (SELECT *, levenshtein(word, term) AS edits FROM cand),
n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY word ORDER BY edits, jaccard DESC, term) <= 50),
fix AS (SELECT word, term FROM n JOIN terms USING (term) QUALIFY row_number() OVER (PARTITION BY word ORDER BY df DESC, term) = 1),
wq AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS qid FROM mis),
kept AS (SELECT qid, 0 AS leaf, idf.term, idf FROM wq LEFT JOIN fix USING (word) JOIN idf ON idf.term = CASE WHEN wq.word IN (SELECT term FROM terms) THEN wq.word ELSE fix.term END WHERE idf >= {IDF_THRESHOLD}),
nk AS (SELECT qid, count(*) AS k FROM kept GROUP BY 1), {_HITS} SELECT qid, doc_id, round(bm25_score, 6) AS score FROM hits""",
        "boolean_shapes": _shapes(),
        "cosine_topk": f"WITH {_VEC} SELECT qid, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, {_COS.format(id='vec_id')} FROM (SELECT a.vec_id AS qid, b.vec_id, round(list_inner_product(a.e, b.e), 9) AS similarity FROM u a, u b WHERE a.vec_id % 50 = 0) QUALIFY rank <= 100)",
        "cluster_centroids": f"WITH {_EMB}, {_CENT} SELECT cluster, i, round(x, 6) AS x FROM cent",
        "top_clusters": f"WITH {_EMB}, {_CENT}, {_NEAR} SELECT qid, cluster, round(distance, 6) AS distance FROM near",
        "ivf_topk": f"WITH {_EMB}, {_CENT}, {_NEAR} SELECT qid, vec_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, {_COS.format(id='vec_id')} FROM (SELECT qid, b.vec_id, round(list_inner_product(a.w, b.w), 9) AS similarity FROM near JOIN u a ON a.vec_id = qid JOIN u b ON b.label = cluster) QUALIFY rank <= 100)",
        "minmax_fusion": f"""WITH {_EMB}, {_EXACT}, p AS (SELECT *, vec_id % 7 + rank * 0.25::DOUBLE AS s FROM ex)
SELECT qid, vec_id, round((similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w + 1e-8) + exp((s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w + 1e-8)) - 1, 5) AS fused FROM p WINDOW w AS (PARTITION BY qid)""",
        "layernorm_truncate": """WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), b AS (SELECT vec_id, e, list_avg(e) AS m FROM a),
c AS (SELECT vec_id, list_transform(e, lambda x: (x - m) / sqrt(list_avg(list_transform(e, lambda y: (y - m) * (y - m))) + 1e-5))[1:16] AS e FROM b),
d AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM c)
SELECT vec_id, generate_subscripts(e, 1) - 1 AS i, round(unnest(e), 5) AS x FROM d""",
    }
