"""The positional two-field index as a set of tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import runs_of, starts_of, term_runs, tokens, trigrams
from rankloom.session import cut, spread, tidy
from rankloom.sources.readers import corpus, dense_index
from rankloom.sources.writers import write_postings


@dataclass
class SearchIndex:
    """docs(doc_id, docid, url, title, body); tokens(doc_id, title_tokens, body_tokens); postings(term, doc_id, pos_title, pos_body, tf_title, tf_body, title_len,
    body_len); terms(term, df); trigrams(trigram, term, n); doc_stats(doc_id, title_len, body_len); corpus_stats, one row
    (n, avg_body, avg_title, max_body, max_title)."""

    docs: DataFrame
    tokens: DataFrame
    postings: DataFrame
    terms: DataFrame
    trigrams: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame

    def save(self, path: str, files: int | None = None) -> None:
        """Parquet tables below path; postings, terms and trigrams sorted for pruned lookups."""
        for f in fields(self):
            _write(getattr(self, f.name), f"{path}/{f.name}", f.name, files)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SearchIndex:
        """Lazy: nothing is read but schemas."""
        return SearchIndex(*[spark.read.parquet(f"{path}/{f.name}") for f in fields(SearchIndex)])

    def stats(self) -> dict[str, float]:
        return self.corpus_stats.first().asDict()

    def verify(self) -> bool:
        """Whether the term table agrees with the postings."""
        t = self.postings.groupBy("term").agg(F.count("*").alias("df"))
        return t.exceptAll(self.terms.select("term", "df")).isEmpty() and self.terms.select("term", "df").exceptAll(t).isEmpty()


def _write(df: DataFrame, path: str, table: str, files: int | None = None) -> DataFrame:
    """Writes one table of an index and gives it as read back."""
    if table == "postings":
        write_postings(df, path, files)
    elif table in ("terms", "trigrams"):
        by = ["term"] if table == "terms" else ["trigram", "term"]
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tokens(F.col("title")).alias("title_tokens"), tokens(F.col("body")).alias("body_tokens"))


def postings_of(tokens: DataFrame) -> DataFrame:
    """Occurrences are grouped inside each document's row: the build shuffles no tokens."""
    s = tokens.select("doc_id", F.size("title_tokens").alias("title_len"), F.size("body_tokens").alias("body_len"), F.array_sort(term_runs(F.col("title_tokens"), F.col("body_tokens"))).alias("_s"))
    s = s.where(F.size("_s") > 0).withColumn("_st", starts_of("_s"))
    x = s.select("doc_id", "title_len", "body_len", F.explode(runs_of("_s", "_st")).alias("x"))
    return x.select("x.term", "doc_id", "x.pos_title", "x.pos_body", F.size("x.pos_title").alias("tf_title"), F.size("x.pos_body").alias("tf_body"), "title_len", "body_len")


def lengths_of(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.size("title_tokens").alias("title_len"), F.size("body_tokens").alias("body_len"))


def frequencies_of(tokens: DataFrame) -> DataFrame:
    """(term, df): in how many documents a term is, in body or title."""
    return tokens.select(F.explode(F.array_union("title_tokens", "body_tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def body_terms_of(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode("body_tokens").alias("term")).distinct()


def corpus_stats_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.avg("body_len").alias("avg_body"), F.avg("title_len").alias("avg_title"), F.max("body_len").alias("max_body"), F.max("title_len").alias("max_title"))


def trigrams_of(terms: DataFrame) -> DataFrame:
    """terms(term): the distinct terms of bodies."""
    g = terms.select("term", trigrams(F.col("term")).alias("_g")).select(F.explode("_g").alias("trigram"), "term", F.size("_g").alias("n"))
    return g.select("trigram", "term", "n")


def _numbered(raw: DataFrame, doc_id: str | None) -> DataFrame:
    ids = raw.select("docid", F.col(doc_id).alias("doc_id")).distinct() if doc_id else dense_index(raw.where("docid is not null").select("docid").distinct(), ["docid"])
    docs = corpus(raw).join(ids, "docid")  # the texts are moved once, and not written to be numbered
    return docs.select("doc_id", "docid", "url", "title", "body")


def build_index(raw: DataFrame, doc_id: str | None = None, written: bool = False) -> SearchIndex:
    """Index of a corpus (docid, url, title, body), one document for each distinct docid.

    Documents are numbered in the order of docid, unless the column doc_id already numbers them. The tables are lazy, so
    save the index before asking it many things; `written` writes those that all queries go back to."""
    keep = cut if written else lambda df: df
    docs = keep(_numbered(raw, doc_id))
    words = keep(tokenized(docs))
    postings, lengths = keep(postings_of(words)), keep(lengths_of(words))
    by_term = keep(postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf_body").alias("in_bodies")))
    return SearchIndex(docs, words, postings, by_term.select("term", "df"), trigrams_of(by_term.where("in_bodies > 0")), lengths, corpus_stats_of(lengths))


def write_index(raw: DataFrame, path: str, doc_id: str | None = None, files: int | None = None) -> SearchIndex:
    """build_index() straight into tables below path, each made from those before it as written: texts are split into
    tokens once, and nothing is computed again. The postings of one file of tokens are sorted where they are made, so none
    is shuffled. Gives the index as loaded."""
    return write_lookups(write_tokens(raw, path, doc_id), path, files)


def write_tokens(raw: DataFrame, path: str, doc_id: str | None = None) -> SearchIndex:
    """The part of write_index() that batches over all documents need: no postings and no trigrams are written, they are
    made when asked."""
    with tidy(raw.sparkSession):
        docs = _write(_numbered(raw, doc_id), f"{path}/docs", "docs")
        words = _write(tokenized(spread(docs)), f"{path}/tokens", "tokens")
        lengths = _write(lengths_of(words), f"{path}/doc_stats", "doc_stats")
        terms = _write(frequencies_of(words), f"{path}/terms", "terms")
        stats = _write(corpus_stats_of(lengths), f"{path}/corpus_stats", "corpus_stats")
    return SearchIndex(docs, words, postings_of(words), terms, trigrams_of(body_terms_of(words)), lengths, stats)


def write_lookups(index: SearchIndex, path: str, files: int | None = None) -> SearchIndex:
    """What write_tokens() leaves out, beside it."""
    _write(index.postings, f"{path}/postings", "postings", files)
    _write(index.trigrams, f"{path}/trigrams", "trigrams")
    return SearchIndex.load(index.docs.sparkSession, path)
