"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", header).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_by_rank(df: DataFrame, path: str, rank: str = "neg_rank", fmt: str = "parquet") -> None:
    """One folder for each rank; a rank's rows lie together, so a reader of one rank reads no other."""
    w = df.repartition(rank).write.mode("overwrite").partitionBy(rank)
    w.parquet(path) if fmt == "parquet" else w.option("sep", "\t").option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_postings(postings: DataFrame, path: str, files: int | None = None) -> None:
    """Sorted by term, so a term lookup prunes row groups and pages by their least and greatest term. As many files as given,
    each with a range of terms; else every task's rows become a file of their own, and none is shuffled."""
    p = postings.repartitionByRange(files, F.col("term"), F.col("doc_id")) if files else postings
    p.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(path)
