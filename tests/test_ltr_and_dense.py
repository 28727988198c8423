import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions import scoring as S
from rankloom.operators import dense, ltr, ranker
from rankloom.operators.search import FEATURES
from rankloom.sources.readers import dense_index, read_corpus, read_matrix, read_qrels, read_queries, read_run
from rankloom.sources.writers import write_by_rank, write_tsv


@pytest.mark.parametrize(
    ("match", "want"),
    [(None, [1, 2, 3, 4, 5, 96, 97, 98, 99, 100]), (3, [1, 2, 4, 5, 6, 96, 97, 98, 99, 100]), (97, [1, 2, 3, 4, 5, 95, 96, 98, 99, 100]), (1, [2, 3, 4, 5, 6, 96, 97, 98, 99, 100])],
)
def test_negative_selection(spark, match, want):
    long = spark.createDataFrame([(r, match) for r in ltr.TRAIN_RANKS], "neg_rank int, match int")
    assert sorted(r[0] for r in ltr.select_negatives(long).select("neg_rank").collect()) == want


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.9, 0), (1, 0.5, 0), (1, 0.1, 0)], "q int, score double, label int")
    r = ltr.evaluate(df, "q").first()
    assert (r["n"], r["mrr"], r["ndcg"]) == (1, 0.5, pytest.approx(0.630930, abs=1e-6))
    s = np.array([[0.5, 0.9, 0.5, 0.1]])
    assert ranker.metrics(s) == (0.5, pytest.approx(0.630930, abs=1e-6))
    for twice in (True, False):
        assert ltr.listwise_loss(df, "q", twice=twice).first()["loss"] == pytest.approx(ranker.loss_and_gradient(s, twice)[0])


@pytest.mark.parametrize("twice", [True, False])
def test_gradient(twice):
    s = np.random.default_rng(0).normal(size=(3, 4))
    _, g = ranker.loss_and_gradient(s, twice)
    for i in np.ndindex(s.shape):
        up, down = s.copy(), s.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        assert g[i] == pytest.approx((ranker.loss_and_gradient(up, twice)[0] - ranker.loss_and_gradient(down, twice)[0]) / 2e-6, abs=1e-6)


def test_training_learns(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(400, 5, 10))
    x[:, 0, 0] += 0.7
    best, last, history = ranker.train(x[:300], x[300:], 16, epochs=15, rate=5e-3, twice=False, log=str(tmp_path / "log"))
    assert history[-1]["train_loss"] < history[0]["train_loss"] and ranker.metrics(best.forward(x[300:]))[0] > 0.8
    assert len((tmp_path / "log").read_text().splitlines()) == 15
    best.save(spark, str(tmp_path / "model"))
    again = ranker.RankingModel.load(spark, str(tmp_path / "model"))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[0]], ", ".join(f"{f} double" for f in FEATURES))
    got = [r["score"] for r in again.scorer(spark)(df).collect()]
    assert sorted(got) == pytest.approx(sorted(best.forward(x[0])))


def test_training_goes_on(spark, tmp_path):
    x = np.random.default_rng(2).uniform(size=(60, 4, 10))
    _, whole, _ = ranker.train(x[:40], x[40:], 8, epochs=4)
    _, half, _ = ranker.train(x[:40], x[40:], 8, epochs=2)
    half.save(spark, str(tmp_path))
    _, again, history = ranker.train(x[:40], x[40:], 8, epochs=2, start=ranker.RankingModel.load(spark, str(tmp_path)))
    assert all(np.allclose(a, b) for a, b in zip(whole.weights, again.weights)) and [h["epoch"] for h in history] == [2, 3]


def test_commands_of_training_and_vectors(spark, tmp_path, capsys):
    from rankloom import cli

    (tmp_path / "c.tsv").write_text("".join(f"d{i}\tu\tred fox {i}\tbody {i % 3}\n" for i in range(12)))
    p = lambda x: str(tmp_path / x)
    cli.main(["index", p("c.tsv"), p("ix")], spark)
    cli.main(["embed", p("ix"), p("v"), "--dim", "16"], spark)
    assert tuple(spark.read.parquet(p("v_about")).first()) == (16, 12)
    cli.main(["cluster", p("v"), p("cl"), "--clusters", "3"], spark)
    assert spark.read.parquet(p("cl/vectors")).count() == 12 and spark.read.parquet(p("cl/centroids")).count() <= 3
    cli.main(["search", p("ix"), "--mode", "SEMANTIC", "--vectors", p("cl/vectors"), "--centroids", p("cl/centroids"), "--dim", "16"], spark, ["red fox 3"])
    rng = np.random.default_rng(0)
    items = [(i, int(j == 0), [float(z) for z in rng.uniform(size=10)]) for i in range(40) for j in range(3)]
    spark.createDataFrame(items, "list int, label int, features array<double>").write.parquet(p("items"))
    for more in ([], ["--resume"]):
        cli.main(["train", p("items"), p("m"), "--list_size", "3", "--epochs", "2", "--hidden_dim", "8", *more], spark)
    assert ranker.RankingModel.load(spark, p("m/last")).state["epoch"] == 4
    assert capsys.readouterr().out.count("40 lists") == 2


def test_collect_lists(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (1, 0, [2.0]), (2, 1, [3.0])], "i int, label int, features array<double>")
    assert ranker.collect_lists(df, "i", 2).tolist() == [[[1.0], [2.0]]]


def test_pivot_match_and_long_form(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "queryid int, docid string, rank int")
    pairs = spark.createDataFrame([(1, "b"), (2, "z"), (3, "a")], "queryid int, docid string")
    wide = ltr.number_rows(ltr.with_negatives(pairs, run, [1, 2]), ["queryid"])
    assert [(r["index"], r["queryid"], r["match"]) for r in wide.orderBy("index").collect()] == [(0, 1, 2), (1, 2, None)]
    long = ltr.negatives_long(wide, [1, 2], ["index"])
    assert sorted(map(tuple, long.collect())) == [(0, 1, "a"), (0, 2, "b"), (1, 1, "c")]
    docs = spark.createDataFrame([("a", "u", "t", "xx"), ("c", "u", "t", "y")], "docid string, url string, title string, body string")
    got = ltr.fetch_negatives(long, docs).withColumn("n", F.length("neg_body"))
    assert sorted(map(tuple, ltr.widen(wide.select("index"), got, [1, 2], ["n"]).collect())) == [(0, 2, None), (1, 1, None)]


def test_split_is_exact_and_stable(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    a = ltr.random_split(df, "k")
    assert {r["split"]: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 82, "val": 10, "test": 11}
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in ltr.random_split(df.repartition(7), "k").collect()}


def test_offline_features(spark):
    from rankloom.operators.index import build_index

    i = build_index(spark.createDataFrame([("a", "u", "red fox", "the fox runs"), ("b", None, None, None)], "docid string, url string, title string, body string"))
    pairs = spark.createDataFrame([(0, 0, "fox zzz"), (1, 1, None)], "i int, doc_id bigint, query string")
    terms = spark.createDataFrame([("fox", 1.5)], "term string, idf double")
    r = {x["i"]: x for x in ltr.offline_features(pairs, i.postings, i.doc_stats, terms, {"avg_body": 3.0, "avg_title": 2.0}, ["i"]).collect()}
    w = 1 + 2.0
    assert r[0]["bm25_score"] == pytest.approx(1.5 * w * 2.6 / (w + 1.6))
    assert r[0]["body_first_occurrence_mean"] == pytest.approx((1 / 3 + 1) / 2) and r[0]["title_first_occurrence_min"] == 0.5
    assert (r[0]["body_length_norm"], r[0]["in_title"]) == (1.0, 1)
    assert [r[1][f] for f in FEATURES] == [0, 0, 0, 1, 1, 1, 1, 0, 0, 0]


def test_vector_functions(spark):
    v = np.random.default_rng(2).normal(size=8)
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    z = (v - v.mean()) / np.sqrt(v.var() + 1e-5)
    assert df.select(S.layer_norm(F.col("v"))).first()[0] == pytest.approx(z.tolist())
    assert df.select(S.truncated(F.col("v"), 3)).first()[0] == pytest.approx((z[:3] / np.linalg.norm(z[:3])).tolist())
    assert spark.range(1).select(S.scaled(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]
    assert spark.range(1).select(S.min_max(F.lit(3.0), F.lit(1.0), F.lit(5.0))).first()[0] == pytest.approx(0.5)
    assert spark.range(1).select(S.fused(F.lit(0.5), F.lit(1.0))).first()[0] == pytest.approx(0.5 + math.e - 1)


def test_exact_and_pruned_search(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(200, 6)).astype("f4")
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "doc_id bigint, embedding array<float>").repartition(5)
    q = [(7, m[7].tolist()), (9, m[9].tolist())]
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = {i: np.argsort(-np.round(u @ u[i], 9), kind="stable")[:5].tolist() for i in (7, 9)}
    got = dense.exact_top(df, q, 5).orderBy("qid", "rank").collect()
    assert {i: [r["doc_id"] for r in got if r["qid"] == i] for i in (7, 9)} == want
    cent = dense.fit_clusters(df, 4, seed=1, max_iter=5)
    placed = dense.assign_clusters(df, cent)
    every = dense.pruned_top(placed, cent, q, 5, probes=4).orderBy("qid", "rank").collect()
    assert [r["doc_id"] for r in every] == [r["doc_id"] for r in got]
    one = dense.pruned_top(placed, cent, q, 200, probes=1)
    cluster = {r["doc_id"]: r["cluster"] for r in placed.collect()}
    assert all(cluster[r["doc_id"]] == cluster[r["qid"]] for r in one.collect())
    near = dense.closest_clusters(spark, q, cent, 1).collect()
    assert {r["qid"]: r["cluster"] for r in near} == {7: cluster[7], 9: cluster[9]}


def test_embed_checks_dimension(spark):
    docs = spark.createDataFrame([(0, "a", None), (1, None, "b")], "doc_id int, title string, body string")
    assert [len(r["embedding"]) for r in dense.embed(docs, dense.hashing_encoder(8), 8).collect()] == [8, 8]
    with pytest.raises(Exception, match="dimensions"):
        dense.embed(docs, dense.hashing_encoder(8), 9).collect()


def test_semantic_mode(spark):
    from rankloom.operators.index import build_index
    from rankloom.operators.search import SearchEngine

    raw = spark.createDataFrame([(f"d{i}", "u", t, t) for i, t in enumerate(["red fox", "blue whale", "red whale", "green ant"])], "docid string, url string, title string, body string")
    i = build_index(raw, written=True)
    enc = dense.hashing_encoder(32)
    v = dense.embed(i.docs.select("doc_id", "title", F.lit("").alias("body")), enc, 32)
    e = SearchEngine(i, None, dense.DenseSearch(v, enc))
    r = e.search([(5, "red fox")], "SEMANTIC", num_return=2).orderBy("rank").collect()
    assert r[0]["docid"] == "d0" and r[0]["score"] == pytest.approx(1.0, abs=1e-6) and r[0]["num_results"] == 4
    cent = dense.fit_clusters(v, 2, max_iter=5)
    e = SearchEngine(i, lambda df: df.withColumn("score", F.col("bm25_score_body")), dense.DenseSearch(dense.assign_clusters(v, cent), enc, cent, probes=2))
    assert e.search([(5, "red fox")], "SEMANTIC").orderBy("rank").first()["docid"] == "d0"
    with pytest.raises(ValueError):
        SearchEngine(i).search(["a"], "SEMANTIC")


def test_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('d1\tu\tti\t"a\tb" c\nd2\tu\n')
    rows = {r["docid"]: r for r in read_corpus(spark, str(tmp_path / "c.tsv")).collect()}
    assert rows["d2"]["title"] == "" and rows["d2"]["body"] == "" and rows["d1"]["title"] == "ti"
    assert read_corpus(spark, str(tmp_path / "c.tsv"), 1).count() == 1
    (tmp_path / "q.tsv").write_text("1\thello world\n")
    (tmp_path / "j").write_text("1 0 d1 2\n")
    (tmp_path / "r").write_text("1 Q0 d1 1 -5.5 alg\n")
    assert tuple(read_queries(spark, str(tmp_path / "q.tsv")).first()) == (1, "hello world")
    assert tuple(read_qrels(spark, str(tmp_path / "j")).first()) == (1, 0, "d1", 2)
    assert tuple(read_run(spark, str(tmp_path / "r")).first()) == (1, "Q0", "d1", 1, -5.5, "alg")
    np.arange(6, dtype="<f4").tofile(tmp_path / "m.bin")
    assert [(r[0], r[1]) for r in read_matrix(spark, str(tmp_path / "m.bin"), 3).orderBy("doc_id").collect()] == [(0, [0, 1, 2]), (1, [3, 4, 5])]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "neg_rank int, x string")
    write_by_rank(df, str(tmp_path / "by"))
    assert spark.read.parquet(str(tmp_path / "by/neg_rank=2")).first()["x"] == "b"
    write_tsv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_dense_index(spark):
    df = spark.createDataFrame([(f"{i * 37 % 101:03d}",) for i in range(101)], "k string").repartition(6)
    got = dense_index(df, ["k"], "i").collect()
    assert {r["k"]: r["i"] for r in got} == {f"{i:03d}": i for i in range(101)}


def test_streaming_and_cli(spark, tmp_path, capsys):
    from rankloom import cli
    from rankloom.operators.search import SearchEngine
    from rankloom.streaming.ingest import ingest, open_index

    schema = "doc_id bigint, docid string, url string, title string, body string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for batch in ([(0, "a", "u", "red fox", "x y")], [(1, "b", "u", "fox", "y z"), (0, "a", "u", "red fox", "x y")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        ingest(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    e = SearchEngine(open_index(spark, out))
    assert {r["docid"] for r in e.search(["fox"], "OR", idf_threshold=None).collect()} == {"a", "b"} and e.stats["n"] == 2
    (tmp_path / "c.tsv").write_text("d1\tu\tred fox\tbody one\nd2\tu\tants\tbody two\nd3\tu\tants\tbody two\n" + "".join(f"e{i}\tu\tx\ty{i}\n" for i in range(9)))
    cli.main(["index", str(tmp_path / "c.tsv"), str(tmp_path / "ix")], spark)
    cli.main(["search", str(tmp_path / "ix"), "--mode", "QUERY_EVALUATOR"], spark, ["fox OR zzz", "(fox"])
    text = capsys.readouterr().out
    assert "d1\tu\tred fox\tbody one" in text and "1 of 1 results" in text and "not understood" in text
