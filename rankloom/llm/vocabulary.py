"""Frequency of every distinct value or term (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import gathered_by_key, words


def record_terms(df: DataFrame, key: str, texts: list[str], length: bool = False) -> DataFrame:
    """(key, term, tf), with `length` (key, length, term, tf): how often each word occurs in the texts of a record, and how
    many words these have, one record for each non-null key.

    The one shuffle is that of the texts by key; counting within a record needs no other."""
    each = gathered_by_key(df, key, *texts)
    w = each.select(key, F.concat(*[words(F.col(c)) for c in texts]).alias("_w"))
    size = [F.size("_w").alias("length")] if length else []
    return w.select(key, *size, F.explode("_w").alias("term")).groupBy(key, *["length"][: len(size)], "term").agg(F.count("*").alias("tf"))


def term_counts(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """(term, occurrences, records) over all records. Counts of a partition are combined by hash before the shuffle."""
    return record_terms(df, key, texts).groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("records"))


def marked_terms(df: DataFrame, key: str = "docid", texts: tuple[str, ...] = ("title", "body"), min_records: int = 3, max_share: float = 0.25) -> DataFrame:
    """(term, occurrences, records, mark): mark is `rare` below min_records records, `common` above max_share of all
    records, else `kept`; `rare` wins where both hold.

    Records are distinct non-null keys; a key that comes twice counts once (of differing rows the smallest counts).
    Null and empty texts have no words, but their records count. Other columns are ignored; an empty table gives an
    empty result. Whole texts of any length are read."""
    n = df.where(F.col(key).isNotNull()).select(key).distinct().count()
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > max_share * n, "common").otherwise("kept")
    return term_counts(df, key, list(texts)).withColumn("mark", mark)
