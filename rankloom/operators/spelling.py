"""Batch spelling correction over the trigram dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.text import trigrams

# How many candidates each step keeps.
BY_JACCARD = 75
BY_EDITS = 50


def jaccard_candidates(words: DataFrame, dictionary: DataFrame, keep: int = BY_JACCARD) -> DataFrame:
    """(word, term, jaccard, place): the `keep` terms of most similar trigram sets that share one with the word.

    words(word) is a batch of query words, so its trigrams are few: they are sent to the dictionary, which is never
    shuffled by itself and is never crossed with the words."""
    grams = trigrams(F.col("word"))
    w = words.select("word").distinct().select("word", F.size(grams).alias("n_word"), F.explode(grams).alias("trigram"))
    both = dictionary.join(w, "trigram").groupBy("word", "n_word", "term", "n").agg(F.count("*").alias("common"))
    j = both.select("word", "term", (F.col("common") / (F.col("n") + F.col("n_word") - F.col("common"))).alias("jaccard"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("jaccard"), "term"))
    return j.withColumn("place", place).where(F.col("place") <= keep)


def corrections(words: DataFrame, dictionary: DataFrame, terms: DataFrame, by_jaccard: int = BY_JACCARD, by_edits: int = BY_EDITS) -> DataFrame:
    """(word, correction, df, edits): of the by_jaccard most similar terms the by_edits of fewest edits, of those the most
    frequent. Ties go by similarity, then by the term. A word that shares no trigram gets no row."""
    c = jaccard_candidates(words, dictionary, by_jaccard).withColumn("edits", F.levenshtein("word", "term"))
    near = Window.partitionBy("word").orderBy("edits", F.desc("jaccard"), "term")
    c = c.withColumn("near", F.row_number().over(near)).where(F.col("near") <= by_edits)
    best = Window.partitionBy("word").orderBy(F.desc("df"), "term")
    c = c.join(terms, "term").withColumn("best", F.row_number().over(best)).where("best = 1")
    return c.select("word", F.col("term").alias("correction"), "df", "edits")
