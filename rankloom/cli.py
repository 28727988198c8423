"""Command line: `python -m rankloom.cli index CORPUS.tsv INDEX`, `embed INDEX VECTORS`, `cluster VECTORS FOLDER`,
`train ITEMS MODEL`, and `search INDEX --mode OR`."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterable

from pyspark.sql import SparkSession

from rankloom.operators.dense import DenseSearch, assign_clusters, embed, fit_clusters, hashing_encoder
from rankloom.operators.index import SearchIndex, write_index
from rankloom.operators.ranker import RankingModel, collect_lists, metrics, train
from rankloom.operators.search import SearchEngine
from rankloom.plans.query_language import SearchMode
from rankloom.session import cut
from rankloom.sources.readers import read_corpus


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rankloom")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("corpus")
    i.add_argument("index")
    i.add_argument("--max_rows", type=int)
    v = sub.add_parser("embed")
    v.add_argument("index")
    v.add_argument("vectors")
    v.add_argument("--dim", type=int, default=64)
    v.add_argument("--max_docs", type=int)
    k = sub.add_parser("cluster")
    k.add_argument("vectors")
    k.add_argument("folder", help="gets the tables centroids and vectors, the latter a folder for each cluster")
    k.add_argument("--clusters", type=int, default=1024)
    t = sub.add_parser("train")
    t.add_argument("items", help="Parquet table (list, label, features)")
    t.add_argument("model")
    t.add_argument("--list_size", type=int, default=11)
    t.add_argument("--epochs", type=int, default=25)
    t.add_argument("--batch_size", type=int, default=64)
    t.add_argument("--lr", type=float, default=5e-4)
    t.add_argument("--hidden_dim", type=int, default=256)
    t.add_argument("--resume", action="store_true", help="go on from the last state in the model's folder")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("--mode", required=True, choices=[m.value for m in SearchMode])
    s.add_argument("--num_return", type=int, default=10)
    s.add_argument("--length_body", type=int, default=100)
    s.add_argument("--disable_spelling_correction", action="store_true")
    s.add_argument("--disable_approximate_nearest_neighbors", action="store_true")
    s.add_argument("--disable_ranking_model", action="store_true")
    s.add_argument("--model", help="folder of a saved ranking model")
    s.add_argument("--vectors", help="Parquet table (doc_id, embedding, cluster)")
    s.add_argument("--centroids", help="Parquet table (cluster, centroid)")
    s.add_argument("--dim", type=int, default=64)
    return p


def open_engine(spark: SparkSession, a: argparse.Namespace) -> SearchEngine:
    index = SearchIndex.load(spark, a.index)
    index.postings = index.postings.persist()
    ranker = RankingModel.load(spark, a.model).scorer(spark) if a.model and not a.disable_ranking_model else None
    dense = None
    if a.vectors:
        dense = DenseSearch(spark.read.parquet(a.vectors), hashing_encoder(a.dim), spark.read.parquet(a.centroids) if a.centroids else None, approximate=not a.disable_approximate_nearest_neighbors)
    return SearchEngine(index, ranker, dense)


def answer(engine: SearchEngine, a: argparse.Namespace, lines: Iterable[str]) -> None:
    for line in lines:
        began = time.time()
        try:
            rows = engine.search([line.strip()], a.mode, a.num_return, snippet_length=a.length_body, spelling=not a.disable_spelling_correction).orderBy("rank").collect()
        except ValueError as e:
            print(f"not understood: {e}")
            continue
        for r in rows:
            print(f"{r['score']:.6f}\t{r['docid']}\t{r['url']}\t{r['title']}\t{r['body_snippet']}")
        print(f"{min(a.num_return, rows[0]['num_results']) if rows else 0} of {rows[0]['num_results'] if rows else 0} results in {time.time() - began:.3f} s")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, lines: Iterable[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("rankloom").getOrCreate()
    if a.command == "index":
        began = time.time()
        write_index(read_corpus(spark, a.corpus, a.max_rows), a.index)
        print(f"indexed in {time.time() - began:.1f} s")
    elif a.command == "embed":
        docs = SearchIndex.load(spark, a.index).docs
        embed(docs, hashing_encoder(a.dim), a.dim, max_docs=a.max_docs).write.mode("overwrite").parquet(a.vectors)
        n = spark.read.parquet(a.vectors).count()
        spark.createDataFrame([(a.dim, n)], "dim int, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{a.vectors}_about")
        print(f"{n} vectors of {a.dim} numbers")
    elif a.command == "cluster":
        vectors = spark.read.parquet(a.vectors)
        cut(fit_clusters(vectors, a.clusters)).write.mode("overwrite").parquet(f"{a.folder}/centroids")
        assign_clusters(vectors, spark.read.parquet(f"{a.folder}/centroids")).write.mode("overwrite").partitionBy("cluster").parquet(f"{a.folder}/vectors")
    elif a.command == "train":
        x = collect_lists(spark.read.parquet(a.items), "list", a.list_size)
        n = len(x)
        start = RankingModel.load(spark, f"{a.model}/last") if a.resume else None
        best, last, history = train(x[: n * 8 // 10], x[n * 8 // 10 : n * 9 // 10], a.hidden_dim, a.epochs, a.batch_size, a.lr, start=start)
        best.save(spark, f"{a.model}/best")
        last.save(spark, f"{a.model}/last")
        mrr, ndcg = metrics(best.forward(x[n * 9 // 10 :]))
        print(f"{n} lists, loss {history[-1]['train_loss']:.4f}, test MRR@10 {mrr:.4f}, nDCG@10 {ndcg:.4f}")
    else:
        answer(open_engine(spark, a), a, lines if lines is not None else sys.stdin)


if __name__ == "__main__":
    main()
