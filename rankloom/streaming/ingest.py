"""Documents that arrive as a stream become postings; documents that come again are taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.index import SearchIndex, corpus_stats_of, lengths_of, postings_of, tokenized, trigrams_of

TABLES = ("docs", "tokens", "postings", "doc_stats")


def ingest(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Index a stream of (doc_id, docid, url, title, body) into tables below path, a folder for each micro-batch.

    doc_id numbers documents at the source. A batch that is tried again overwrites its own folders, so a failure leaves
    nothing twice. A docid that was indexed before is left out by an anti join on ids alone."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        docs = batch.where("docid is not null").dropDuplicates(["docid"])
        try:
            docs = docs.join(spark.read.parquet(f"{path}/docs").where(F.col("epoch") != epoch).select("docid"), "docid", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        docs = docs.select("doc_id", "docid", *[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "title", "body")]).persist()
        words = tokenized(docs)
        for name, df in (("tokens", words), ("postings", postings_of(words)), ("doc_stats", lengths_of(words)), ("docs", docs)):
            df.write.mode("overwrite").parquet(f"{path}/{name}/epoch={epoch}")
        docs.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    """The index of all batches so far; statistics are combined at reading."""
    docs, words, postings, lengths = (spark.read.parquet(f"{path}/{t}").drop("epoch") for t in TABLES)
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf_body").alias("in_bodies"))
    return SearchIndex(docs, words, postings, terms.select("term", "df"), trigrams_of(terms.where("in_bodies > 0")), lengths, corpus_stats_of(lengths))
