"""The engine on a small hand corpus with known answers."""

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import snippet, tokens, trigrams
from rankloom.operators.index import SearchIndex, build_index, write_index
from rankloom.operators.search import FEATURES, SearchEngine, as_batch
from rankloom.operators.spelling import corrections
from rankloom.plans.query_language import SearchMode
from rankloom.queries import queries

CORPUS = [
    ("d0", "u0", "red fox", "the quick red fox jumps over the lazy dog"),
    ("d1", "u1", "lazy dogs", "a lazy dog sleeps while the red bird sings"),
    ("d2", "u2", "", "quick brown cats chase red red mice"),
    ("d3", "u3", "fox news", "news about the quick market"),
    ("d4", "u4", "empty body", None),
    ("d5", "u5", "bird watching", "the bird watches the red fox quick"),
    ("d5", "u5", "bird watching", "the bird watches the red fox quick"),
    (None, "u6", "no id", "nothing"),
]


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine(build_index(spark.createDataFrame(CORPUS, "docid string, url string, title string, body string"), written=True))


def test_statistics(engine):
    s = engine.stats
    assert (s["n"], s["max_body"], s["max_title"]) == (6, 9, 2)
    assert s["avg_body"] == pytest.approx(37 / 6) and s["avg_title"] == pytest.approx(10 / 6)
    assert engine.index.verify()


def found(engine, query, mode, **options):
    options = {"idf_threshold": None, "spelling": False, "num_return": 100} | options
    return {r["doc_id"]: r["score"] for r in engine.search([query], mode, **options).collect()}


@pytest.mark.parametrize(
    ("query", "mode", "docs"),
    [
        ("quick red", "AND", {0, 2, 5}),
        ("bird market", "OR", {1, 3, 5}),
        ("red fox", "NOT", {4}),
        ("red fox", "PHRASE", {0, 5}),
        ("red red", "PHRASE", {2}),
        ("lazy dog", "PHRASE", {0, 1}),
        ("fox quick", "PHRASE", {5}),
        ("fox", "PHRASE", {0, 3, 5}),
        ("fox the", "PHRASE", set()),  # not across title and body
        ("(bird OR fox) AND NOT lazy", "QUERY_EVALUATOR", {3, 5}),
        ('"red fox" OR market', "QUERY_EVALUATOR", {0, 3, 5}),
        ('NOT "red fox"', "QUERY_EVALUATOR", {1, 2, 3, 4}),
        ("fox OR NOT red", "QUERY_EVALUATOR", {0, 3, 4, 5}),
        ("unknownword", "OR", set()),
        ("unknownword", "NOT", {0, 1, 2, 3, 4, 5}),
        ("", "AND", set()),
    ],
)
def test_modes(engine, query, mode, docs):
    assert set(found(engine, query, mode)) == docs


def test_scores(engine):
    got = found(engine, "bird market", "OR")
    assert got == pytest.approx({3: 1.423588, 5: 0.952514, 1: 0.484949}, abs=1e-6)
    got = found(engine, "fox news", "OR")
    assert got == pytest.approx({3: 2.178217, 0: 0.0, 5: 0.0}, abs=1e-6)


def test_features(engine):
    m = engine.matches(engine.compile([(7, "fox news")], SearchMode.OR, False, None))
    rows = {r["doc_id"]: [r[f] for f in FEATURES] for r in m.collect()}
    assert rows[3] == pytest.approx([2.178217, 1.423588, 1.189484, 0.5, 0.25, 0.0, 0.0, 0.555556, 1.0, 1], abs=1e-6)
    assert rows[0] == pytest.approx([0, 0, 0, 0.666667, 0.75, 0.333333, 0.5, 1.0, 1.0, 1], abs=1e-6)


def test_batch_keeps_queries_apart(engine):
    r = engine.search([(1, "quick red"), (2, "bird"), (3, "")], SearchMode.AND, idf_threshold=None)
    got = {}
    for x in r.collect():
        got.setdefault(x["qid"], set()).add(x["doc_id"])
    assert got == {1: {0, 2, 5}, 2: {1, 5}}


def test_repeated_words_score_again(engine):
    once, twice = found(engine, "market", "OR"), found(engine, "market market", "OR")
    assert twice[3] == pytest.approx(2 * once[3])


def test_stop_words(engine):
    # every term is frequent in so small a corpus; NOT of dropped words takes nothing away
    assert found(engine, "red fox", "AND", idf_threshold=1.5) == {}
    assert set(found(engine, "red fox", "NOT", idf_threshold=1.5)) == {0, 1, 2, 3, 4, 5}


def test_batches_are_bounded(engine):
    with pytest.raises(ValueError):
        as_batch(["a", "b"], 1)


def test_complements_keep_their_order_and_totals(engine):
    """The first of a NOT query are found without listing the whole collection; totals count all."""
    r = engine.search([(1, "fox"), (2, "market"), (3, "zzz")], "NOT", num_return=2, idf_threshold=None, spelling=False).collect()
    got = {q: [(x["doc_id"], x["num_results"]) for x in sorted(r, key=lambda x: x["rank"]) if x["qid"] == q] for q in (1, 2, 3)}
    assert got == {1: [(1, 3), (2, 3)], 2: [(0, 5), (1, 5)], 3: [(0, 6), (1, 6)]}


def test_written_index_reads_only_what_it_needs(engine, spark, tmp_path):
    e = SearchEngine(write_index(spark.createDataFrame(CORPUS, "docid string, url string, title string, body string"), str(tmp_path)))
    assert e.index.verify() and found(e, "bird market", "OR") == pytest.approx(found(engine, "bird market", "OR"))
    plan = e.matches(e.compile([(1, "bird market")], SearchMode.OR, False, None))._jdf.queryExecution().toString()
    assert "In(term, [bird,market])" in plan


def test_limits_and_totals(engine):
    r = engine.search(["red"], "OR", num_return=2, idf_threshold=None).orderBy("rank").collect()
    assert [x["rank"] for x in r] == [1, 2] and {x["num_results"] for x in r} == {4}


def test_spelling(engine, spark):
    assert set(found(engine, "markt", "OR", spelling=True)) == {3}
    w = spark.createDataFrame([("birb",), ("zzzz",)], "word string")
    assert [(r["word"], r["correction"], r["edits"]) for r in corrections(w, engine.index.trigrams, engine.index.terms).collect()] == [("birb", "bird", 1)]


def test_save_and_load(engine, spark, tmp_path):
    engine.index.save(str(tmp_path), 2)
    again = SearchEngine(SearchIndex.load(spark, str(tmp_path)))
    assert found(again, "bird market", "OR") == pytest.approx(found(engine, "bird market", "OR"))


def test_reranker_changes_order(engine):
    by_body = SearchEngine(engine.index, lambda df: df.withColumn("score", -F.col("bm25_score")))
    r = by_body.search(["bird market"], "OR", idf_threshold=None).orderBy("rank").collect()
    assert [x["doc_id"] for x in r] == [1, 5, 3]


def test_text_functions(spark):
    df = spark.createDataFrame([("a",), ("ab",), ("abc",), ("aaaa",), ("",)], "t string")
    assert [sorted(r[0]) for r in df.select(trigrams(F.col("t"))).collect()] == [["$a$"], ["$ab", "ab$"], ["$ab", "abc", "bc$"], ["$aa", "aa$", "aaa"], []]
    assert spark.range(1).select(tokens(F.lit('Don\'t "stop" x_1 é!'))).first()[0] == ["don", "'", "t", '"', "stop", '"', "x_1", "é", "!"]
    assert spark.range(1).select(snippet(F.lit("aé"), 2)).first()[0] == "a\ufffd"


def test_empty_corpus(spark):
    e = SearchEngine(build_index(spark.createDataFrame([], "docid string, url string, title string, body string")))
    assert e.search(["a"], "OR").count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The corpus with queries of which no id is divisible by 50."""
    d = str(tmp_path_factory.mktemp("tables"))
    # padding makes the words rare enough to be kept
    docs = CORPUS + [(f"e{i:02}", "u", f"pad{i} more{i}", f"filler{i} only{i}") for i in range(60)]
    spark.createDataFrame(docs, "docid string, url string, title string, body string").write.parquet(f"{d}/msmarco_docs.parquet")
    spark.createDataFrame([(1, "red fox"), (2, "lazy dog quick"), (3, "red fox jumps"), (7, "zzz"), (8, None), (9, "")], "queryid bigint, query string").write.parquet(f"{d}/train_queries.parquet")
    v = spark.range(66).selectExpr("id AS vec_id", "CASE WHEN id < 6 THEN concat('d', id) ELSE concat('e', lpad(id - 6, 2, '0')) END AS docid", "transform(sequence(1, 64), i -> cast(sin(id * i) + 2 AS float)) AS embedding")
    v.write.parquet(f"{d}/doc_vectors.parquet")
    return d


def by_query(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["qid"], set()).add(r["doc_id"])
    return out


def test_match_not_answers_every_query(spark, tables):
    got = by_query(queries()["match_not"](spark, tables))
    assert set(got) == {1, 2, 3, 7} and got[7] == set(range(66))
    assert got[1] == {4, *range(6, 66)} and got[2] == {4, *range(6, 66)}


def test_boolean_shapes_answer_every_query(spark, tables):
    got = by_query(queries()["boolean_shapes"](spark, tables))
    assert {q // 10 for q in got} == {2, 3}
    assert (got[20], got[24], got[25], got[30], got[39]) == ({0, 1}, {0, 1, 2, 3, 5}, {1}, {0, 5}, {0})


@pytest.mark.parametrize("name", ["features_topk", "reranked_results", "match_boolean_nested", "match_phrase", "semantic_search", "semantic_lexical_join"])
def test_no_row_of_query_and_document_is_shuffled(spark, tables, monkeypatch, name):
    monkeypatch.setattr("rankloom.queries._batch", lambda *_: [(50, "red fox"), (100, "lazy dog quick")])
    monkeypatch.setattr("rankloom.queries._title_starts", lambda *_: [(50, "red fox")])

    def refuse(*_):
        raise AssertionError("pairs are gathered by query and document")

    monkeypatch.setattr(SearchEngine, "_grouped", refuse)
    got = by_query(queries()[name](spark, tables).withColumn("doc_id", F.lit(0)))
    assert 50 in got or name == "match_boolean_nested" and 100 in got
