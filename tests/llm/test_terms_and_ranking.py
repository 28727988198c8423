import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import distinctive, fusion, vocabulary

DOCS = [("d1", "Red fox", "a a a fox_fox b"), ("d2", None, "b b c"), ("d2", None, "b b c"), ("d3", "red", None), ("d4", "", "   "), (None, "lost", "lost"), ("d5", "long", "w " * 50_000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "docid string, title string, body string").withColumn("term", F.lit("clash")).withColumn("tf", F.lit(9))


def test_marked_terms(spark, docs, rows):
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in vocabulary.marked_terms(docs, min_records=2, max_share=0.3).collect()}
    assert got == {"red": (2, 2, "common"), "fox": (3, 1, "rare"), "a": (3, 1, "rare"), "b": (3, 2, "common"), "c": (1, 1, "rare"), "long": (1, 1, "rare"), "w": (50_000, 1, "rare")}
    assert vocabulary.marked_terms(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [64_000_000, 0])
def test_term_scores(spark, docs, broadcast_bytes):
    q = spark.createDataFrame([(0, "fox zzz FOX"), (1, None), (2, ""), (3, "a b")], "row_index bigint, query string")
    got = {(r["field"], r["record_key"], r["term"]): r for r in distinctive.term_scores(docs, others=(("query", q, "row_index", "query"),), mu=10, broadcast_bytes=broadcast_bytes).collect()}
    body = {"d1": ["a"] * 3 + ["fox", "fox", "b"], "d2": ["b", "b", "c"], "d5": ["w"] * 50_000}
    cf = Counter(w for x in body.values() for w in x)
    df = Counter(w for x in body.values() for w in set(x))
    want = [("body", k, Counter(v), len(v)) for k, v in body.items()] + [("query", "0", Counter({"fox": 2}), 3), ("query", "3", Counter({"a": 1, "b": 1}), 2)]
    assert set(got) == {(f, k, w) for f, k, c, _ in want for w in c}
    total = sum(cf.values())
    for f, k, c, n in want:
        for w, tf in c.items():
            pc = cf[w] / total
            p = (tf + 10 * pc) / (n + 10)
            r = got[f, k, w]
            assert (r["tf"], r["df"]) == (tf, df[w]) and r["score"] == pytest.approx(p * math.log(p / pc))
    assert all(r["df"] >= 2 for r in distinctive.term_scores(docs, min_df=2).collect())


def test_term_scores_of_nothing(docs):
    assert distinctive.term_scores(docs.limit(0)).count() == 0


def test_ideal_point_ranking(spark):
    s = "queryid bigint, row_index bigint, a double, b double, source string, _s0 int"
    recs = [(1, 1, 100.0, 0.9, "x", 0), (1, 2, 90.0, 0.1, "x", 0), (1, 3, 10.0, 0.9, "x", 0), (1, 4, None, None, "x", 0), (2, 5, float("nan"), 0.5, "x", 0), (None, 6, 50.0, 0.5, "x", 0), (1, 7, 0.1, 0.9, None, 0)]
    r = fusion.ideal_point_ranking(spark.createDataFrame(recs, s), {"a": 1, "b": -1}, tail=0.0).collect()
    by = {x["row_index"]: x for x in r}
    assert set(by) == {1, 2, 3, 4, 5, 7} and by[5]["place"] == 1
    assert sorted(x["place"] for x in r if x["queryid"] == 1) == [1, 2, 3, 4, 5]
    assert by[2]["place"] == 1 and by[4]["closeness"] == 0.5 and by[7]["closeness"] == 0.5
    assert by[4]["place"] < by[7]["place"]  # a tie, by row


def test_scale_of_a_source_does_not_matter(spark):
    recs = [(q, q * 10 + i, float((i * 7 + q) % 10), float((i * 3) % 10), "xy"[i % 2]) for q in range(20) for i in range(6)]
    s = "queryid bigint, row_index bigint, a double, b double, source string"
    rank = lambda rs: {x["row_index"]: x["place"] for x in fusion.ideal_point_ranking(spark.createDataFrame(rs, s), {"a": 1, "b": 1}).collect()}
    scaled = [(q, i, a * (1000 if src == "y" else 1), b * 0.01, src) for q, i, a, b, src in recs]
    assert rank(recs) == rank(scaled)
    assert fusion.ideal_point_ranking(spark.createDataFrame([], s), {"a": 1}).count() == 0


def brute_order(recs, signs, norm=True):
    """Closeness from the definition, in NumPy, over one unit without tails."""
    x = np.array(recs, float)
    v = x / (np.sqrt((x**2).mean(axis=0)) if norm else np.ptp(x, axis=0))
    best = np.where(np.array(signs) > 0, v.max(axis=0), v.min(axis=0))
    worst = np.where(np.array(signs) > 0, v.min(axis=0), v.max(axis=0))
    plus, minus = (np.sqrt(((v - p) ** 2).sum(axis=1)) for p in (best, worst))
    return minus / (plus + minus)


def test_the_norm_counts(spark):
    """A score that hardly varies for its size counts less than one that does; scaled to its range, it would count alike."""
    rng = np.random.default_rng(3)
    x = np.c_[rng.uniform(100, 104, 60), rng.normal(0, 7, 60), rng.exponential(2, 60)]
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(x)], "queryid int, row_index int, a double, b double, c double")
    got = {r["row_index"]: (r["place"], r["closeness"]) for r in fusion.ideal_point_ranking(df, {"a": 1, "b": 1, "c": -1}, unit=None, tail=0.0).collect()}
    want = brute_order(x, (1, 1, -1))
    assert [got[i][1] for i in range(60)] == pytest.approx(want.tolist(), abs=1e-8)
    order = lambda c: np.argsort(np.argsort(-c)) + 1
    places = np.array([got[i][0] for i in range(60)])
    assert (places == order(want)).all() and (places != order(brute_order(x, (1, 1, -1), norm=False))).sum() > 10
