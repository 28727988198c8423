"""How distinctive a term is per record (problem 4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut, words
from rankloom.llm.vocabulary import record_terms


def divergence(tf: Column, length: Column, cf: Column, total: float, mu: float) -> Column:
    """A term's part of the relative entropy between a record's Dirichlet-smoothed distribution and the collection's."""
    pc = cf / F.lit(float(total))
    pd = (tf + mu * pc) / (length + mu)
    return pd * F.ln(pd / pc)


def _with_stats(postings: DataFrame, stats: DataFrame, broadcast_bytes: int) -> DataFrame:
    """postings joined to their terms' counts. Counts of up to broadcast_bytes (terms and 40 bytes for each) are broadcast,
    so postings stay where they are. Beyond it both sides are shuffled by term, but for the terms that hold more than 1/512
    of all postings: there are fewer than 512 of those, so they are broadcast, and no task gets a hot term."""
    size, total = stats.agg(F.sum(F.octet_length("term") + 40), F.sum("df")).first()
    if (size or 0) <= broadcast_bytes:
        return postings.join(F.broadcast(stats), "term")
    hot = F.broadcast(stats.where(F.col("df") * 512 > total))
    rest = postings.join(hot.select("term"), "term", "left_anti").join(stats.where(F.col("df") * 512 <= total), "term")
    return postings.join(hot, "term").unionByName(rest)


def term_scores(
    collection: DataFrame,
    key: str = "docid",
    text: str = "body",
    others: tuple[tuple[str, DataFrame, str, str], ...] = (),
    min_df: int = 1,
    mu: float = 500.0,
    broadcast_bytes: int = 64_000_000,
) -> DataFrame:
    """(field, record_key, term, tf, df, score) for every word of every record.

    The collection's own records (field = `text`) are one for each distinct non-null key; `others` are further
    (field, table, key, text) scored against the same collection, one record for each row. The score is the word's
    contribution to the divergence of the record's smoothed distribution from the collection's. Words in fewer than
    min_df records of the collection, so all that it doesn't hold, get no row. Null, empty and wordless texts have no
    rows; rows that are repeated in another table give their rows again; clashing column names are ignored; an empty
    collection gives an empty result. Very long texts are read whole.

    The collection's texts are split into words once: the counts of each record are written, and both the collection's
    counts and the scores come from them."""
    own = cut(record_terms(collection.select(F.col(key).cast("string").alias("record_key"), F.col(text).alias("_t")), "record_key", ["_t"], length=True))
    stats = cut(own.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df")))
    total = float(stats.agg(F.sum("cf")).first()[0] or 1)
    known = stats.where(F.col("df") >= min_df)

    def scored(field: str, p: DataFrame) -> DataFrame:
        """p(record_key, length, term, tf)"""
        s = divergence(F.col("tf").cast("double"), F.col("length").cast("double"), F.col("cf").cast("double"), total, mu)
        return _with_stats(p, known, broadcast_bytes).select(F.lit(field).alias("field"), "record_key", "term", "tf", "df", s.alias("score"))

    out = scored(text, own)
    for field, df, k, t in others:
        out = out.unionByName(scored(field, _counted(df.select(F.col(k).cast("string").alias("record_key"), F.col(t).alias("_t")))))
    return out


def _counted(df: DataFrame) -> DataFrame:
    """(record_key, length, term, tf) of each row, counted inside it: equal words stand together once sorted, so a word's
    count is the distance between two starts. Nothing is shuffled, and rows of one key stay apart."""
    w = df.select("record_key", F.sort_array(words(F.col("_t"))).alias("_w")).where(F.size("_w") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_w") - 1), lambda i: (i == 0) | (F.col("_w")[i] != F.get(F.col("_w"), i - 1)))
    w = w.select("record_key", "_w", F.size("_w").alias("length"), starts.alias("_s"))
    runs = F.transform("_s", lambda s, k: F.struct(F.get(F.col("_w"), s).alias("term"), (F.coalesce(F.get(F.col("_s"), k + 1), F.col("length")) - s).cast("bigint").alias("tf")))
    return w.select("record_key", "length", F.explode(runs).alias("_x")).select("record_key", "length", "_x.term", "_x.tf")
