"""Scans. Delimited files always get an explicit schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.session import cut

CORPUS = "docid string, url string, title string, body string"
QUERIES = "queryid bigint, query string"
QRELS = "queryid bigint, dummy int, docid string, rel int"
RUN = "queryid bigint, dummy string, docid string, rank int, score double, algorithm string"


def _delimited(spark: SparkSession, path: str, schema: str, sep: str, header: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).option("quote", '"').option("mode", "PERMISSIVE").csv(path)


def read_corpus(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    """Tab-separated docid, url, title, body. A field that starts with a quote is unquoted; missing fields are empty."""
    df = _delimited(spark, path, CORPUS, "\t").fillna("", ["url", "title", "body"])
    return df if max_rows is None else df.limit(max_rows)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, QUERIES, "\t")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, QRELS, " ")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, path, RUN, " ")


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def read_matrix(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(doc_id, embedding) from a raw little-endian float32 file of rows of `dim` numbers, row i being document i.

    Spark cuts the file into fixed-length records; a short last record is left out."""
    raw = spark.sparkContext.binaryRecords(path, 4 * dim).zipWithIndex().map(lambda r: (r[1], bytearray(r[0])))

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            m = np.frombuffer(b"".join(pdf.raw), "<f4").reshape(-1, dim)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "embedding": list(m)})

    return spark.createDataFrame(raw, "doc_id bigint, raw binary").mapInPandas(rows, "doc_id bigint, embedding array<float>")


def corpus(df: DataFrame) -> DataFrame:
    """One row per non-null docid, null fields as empty strings."""
    kept = F.min(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("url", "title", "body")])).alias("x")
    return df.where("docid is not null").groupBy("docid").agg(kept).select("docid", "x.url", "x.title", "x.body")


def dense_index(df: DataFrame, by: list[str], name: str = "doc_id") -> DataFrame:
    """Number the rows 0, 1, ... in the order of `by` without bringing them into one task.

    Rows are range-partitioned and written; a partition's first number is the count of those before it, one small row a
    partition. Rows that tie on `by` get their numbers in no set order."""
    parts = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before", "_n")
