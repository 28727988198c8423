"""Batch search: matching, BM25 ranking, re-ranking and fetching of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import scoring as S
from rankloom.functions.text import snippet
from rankloom.operators.blocks import PARTS, Asked, all_matches, best_matches, sums_of
from rankloom.operators.index import SearchIndex
from rankloom.operators.spelling import corrections
from rankloom.plans.query_language import Leaf, Node, SearchMode, holds, leaves, numbered, parse, predicate, simplified
from rankloom.session import cut

# The ten features of a (query, document) pair, in their order.
FEATURES = ["bm25_score", "bm25_score_body", "bm25_score_title", "body_first_occurrence_mean", "title_first_occurrence_mean", "body_first_occurrence_min", "title_first_occurrence_min", "body_length_norm", "title_length_norm", "in_title"]
CANDIDATES = 100
MAX_BATCH = 100_000  # queries of one batch; what is broadcast is bounded by it
BROADCAST_ROWS = 1_000_000  # rows of a batch's words that are broadcast; more are left to the planner
SLICE = 50_000  # queries compiled together
LITERALS = 10_000  # words that a plan holds as literals
RETURNED = 10
SNIPPET = 100


def with_idf(index: SearchIndex) -> DataFrame:
    """terms(term, df, idf)."""
    n = index.stats()["n"]
    return index.terms.select("term", "df", S.idf(F.lit(n), F.col("df")).alias("idf"))


def frequent_terms(index: SearchIndex, threshold: float = S.IDF_THRESHOLD) -> DataFrame:
    """terms(term, df, idf) that the threshold drops from queries."""
    return with_idf(index).where(F.col("idf") < threshold)


@dataclass
class Compiled:
    """A batch of parsed queries after spelling and stop words: what the plan is built from."""

    qids: list[int]
    trees: dict[int, Node] = field(default_factory=dict)  # none for a query that matches nothing
    every: set[int] = field(default_factory=set)  # queries that every document matches
    words: list[tuple[int, int, int, str, float]] = field(default_factory=list)  # qid, leaf, offset in leaf, term, idf
    n_words: dict[int, int] = field(default_factory=dict)


class SearchEngine:
    """search() answers a whole batch of queries in one plan.

    The driver parses the queries and looks up their words, both bounded by the batch. The rest is one plan: the words
    are sent to the postings, whose rows of those terms alone are read; (query, document) rows are combined in one shuffle;
    the candidates of a query are cut by a window-group limit, which keeps just so many in each task before it sorts; the
    documents' texts are joined last, for the returned rows alone."""

    def __init__(self, index: SearchIndex, ranker: Callable[[DataFrame], DataFrame] | None = None, dense: object | None = None) -> None:
        self.index, self.ranker, self.dense = index, ranker, dense
        self._stats: dict[str, float] | None = None

    @property
    def stats(self) -> dict[str, float]:
        if self._stats is None:
            self._stats = self.index.stats()
        return self._stats

    # --- the driver's part -------------------------------------------------------------------------------------------

    def _lookup(self, words: Iterable[str]) -> dict[str, int]:
        w = sorted(set(words))
        if not w:
            return {}
        if len(w) > LITERALS:
            asked = _few(self.index.docs.sparkSession.createDataFrame([(x,) for x in w], "term string"), len(w))
            return {r["term"]: r["df"] for r in self.index.terms.join(asked, "term").collect()}
        return {r["term"]: r["df"] for r in self.index.terms.where(F.col("term").isin(w)).collect()}

    def compile(self, queries: list[tuple[int, str | None]], mode: SearchMode, spelling: bool = True, idf_threshold: float | None = S.IDF_THRESHOLD) -> Compiled:
        """Spelling changes unknown plain words, the threshold drops frequent plain words; phrases stay as they are.

        A word that is dropped is as if it hadn't been asked for, also below NOT, where nothing is then taken away. An
        unknown word matches nothing. A query with no word left matches nothing."""
        n = self.stats["n"]
        parsed = {q: parse(t, mode) for q, t in queries}
        asked = {w for t in parsed.values() for x in leaves(t) for w in x.words}
        df = self._lookup(asked)
        fixed: dict[str, str] = {}
        unknown = sorted({x.words[0] for t in parsed.values() for x in leaves(t) if not x.exact and x.words[0] not in df})
        if spelling and unknown:
            spark = self.index.docs.sparkSession
            w = spark.createDataFrame([(x,) for x in unknown], "word string")
            for r in corrections(w, self.index.trigrams, self.index.terms).collect():
                fixed[r["word"]] = r["correction"]
                df[r["correction"]] = r["df"]

        def idf(w: str) -> float:
            from math import log

            d = df.get(w, 0)
            return log((n - d + 0.5) / (d + 0.5)) if n else 0.0

        def change(x: Leaf) -> Leaf | None:
            if x.exact:
                return x
            w = fixed.get(x.words[0], x.words[0])
            if idf_threshold is not None and w in df and idf(w) < idf_threshold:
                return None
            return Leaf((w,))

        out = Compiled([q for q, _ in queries])
        for q, t in parsed.items():
            tree, every = simplified(t, change)
            if every:
                out.every.add(q)
            if tree is None:
                continue
            out.trees[q] = tree
            scored = [(i, k, w) for i, x in enumerate(leaves(tree)) for k, w in enumerate(x.words)]
            out.n_words[q] = len(scored)
            out.words += [(q, i, k, w, idf(w)) for i, k, w in scored if w in df]
        return out

    # --- where the documents are read ---------------------------------------------------------------------------------

    def compiled(self, queries: Iterable[tuple[int, str]], mode: SearchMode, **options: object) -> Iterator[Compiled]:
        """compile() of however many queries, some at a time, as the driver can't hold the trees of all."""
        it = iter(queries)
        while part := list(islice(it, SLICE)):
            yield self.compile(part, mode, **options)

    def _asked(self, parts: Iterable[Compiled]) -> Asked:
        idf: dict[str, float] = {}
        place: dict[str, int] = {}
        by: dict[tuple, tuple[Node | None, list[np.ndarray], list[np.ndarray]]] = {}
        for c in parts:
            for w in c.words:
                if w[3] not in place:
                    place[w[3]] = len(place)
                    idf[w[3]] = w[4]
            own: dict[tuple, tuple[list[list[int]], list[int]]] = {}
            for q in dict.fromkeys(c.qids):
                if q not in c.trees and q not in c.every:
                    continue
                t = c.trees.get(q)
                found = leaves(t)
                key = (None if t is None else numbered(t)[0], tuple(len(x.words) for x in found))
                if key not in by:
                    by[key] = (t, [], [])
                words, qids = own.setdefault(key, ([], []))
                words.append([place.get(w, -1) for x in found for w in x.words])
                qids.append(q)
            for key, (words, qids) in own.items():
                by[key][1].append(np.array(words, "i4").reshape(len(qids), -1))
                by[key][2].append(np.array(qids, "i8"))
        out = Asked(list(place), np.array([idf[t] for t in place]), (float(self.stats["avg_title"] or 0), float(self.stats["avg_body"] or 0)))
        for (_, sizes), (t, words, qids) in by.items():
            out.add(t, list(sizes), np.concatenate(words), np.concatenate(qids))
        return out

    def _in_blocks(self, asked: Asked, f: Callable, schema: str, *args: object, tasks: int | None = None) -> DataFrame:
        """f over the tokens, with the batch and args sent to the tasks."""
        t = self.index.tokens.select("doc_id", "title_tokens", "body_tokens")
        sent = t.sparkSession.sparkContext.broadcast((asked, args))
        return (t.coalesce(tasks) if tasks else t).mapInArrow(lambda it: f(sent.value[0], it, *sent.value[1]), schema)

    def all_matches(self, parts: Iterable[Compiled], score: bool = True) -> DataFrame:
        """(qid, doc_id) and the score over both fields of every document that a query matches; nothing is shuffled."""
        return self._in_blocks(self._asked(parts), all_matches, "qid bigint, doc_id bigint" + f", {PARTS[0]} double" * score, score)

    def best(self, c: Compiled, k: int, score: str = PARTS[0]) -> DataFrame:
        """(qid, doc_id, num_results): top() of all matches, written. A task keeps each query's best k, so at most k rows a
        query and core are shuffled."""
        spark = self.index.docs.sparkSession
        asked = self._asked([c])
        qids = [(i, q) for i, _, _, own in asked.kinds() for q in own.tolist()]
        part = self._in_blocks(asked, best_matches, "kind bigint, doc_id bigint, score double, n bigint", k, PARTS.index(score), tasks=spark.sparkContext.defaultParallelism)
        w = Window.partitionBy("kind")
        r = part.withColumn("num_results", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
        return cut(r.join(_few(spark.createDataFrame(qids, "kind bigint, qid bigint"), len(qids)), "kind").select("qid", "doc_id", "num_results"))

    def lexical(self, c: Compiled, pairs: DataFrame) -> DataFrame:
        """As matches(), of these pairs (qid, doc_id) alone, as far as they hold a word of the query. Of a batch's queries
        there are some hundred each, so they are sent to the tasks."""
        p = pairs.select("qid", "doc_id").toArrow()
        qids, docs = p["qid"].to_numpy(), p["doc_id"].to_numpy()
        order = np.argsort(docs, kind="stable")
        schema = "qid bigint, doc_id bigint, s double, sb double, st double, k bigint, fb double, ft double, fb_min double, ft_min double, title_len bigint, body_len bigint"
        return self._features(c, self._in_blocks(self._asked([c]), sums_of, schema, docs[order], qids[order]))

    # --- the plan ----------------------------------------------------------------------------------------------------

    def matches(self, c: Compiled, first: int | None = None) -> DataFrame:
        """(qid, doc_id, three BM25 scores, features) of every document that a query matches; with `first`, of queries that
        match documents without any of their words only as many of those as the first so many of all need."""
        return self._features(c, self._found(c, self._grouped(c), first))

    def _grouped(self, c: Compiled) -> DataFrame:
        """(qid, doc_id, sums, _holds): the documents that hold a word of a query, and whether they match it."""
        spark = self.index.docs.sparkSession
        long = {(q, i) for q, t in c.trees.items() for i, x in enumerate(leaves(t)) if len(x.words) > 1}
        size = {(q, i): len(leaves(c.trees[q])[i].words) for q, i in long}
        words = spark.createDataFrame([(*w, size.get(w[:2], 0)) for w in c.words], "qid bigint, leaf int, offset int, term string, idf double, n_phrase int")
        terms = sorted({w[3] for w in c.words})
        postings = self.index.postings.where(F.col("term").isin(terms)) if len(terms) <= 1000 else self.index.postings.where(F.col("term").between(terms[0], terms[-1]))
        hits = postings.join(_few(words, len(c.words)), "term")
        st = self.stats
        weight = lambda f: S.term_weight(F.col(f"tf_{f}"), F.col(f"{f}_len"), F.lit(float(st[f"avg_{f}"] or 0)))
        first = lambda f: F.coalesce(F.get(F.col(f"pos_{f}"), 0) / F.col(f"{f}_len"), F.lit(1.0))
        both = weight("body") + S.TITLE_WEIGHT * weight("title")
        rows = hits.select(
            "qid", "doc_id", F.when(F.col("n_phrase") == 0, F.col("leaf")).alias("leaf"), "title_len", "body_len",
            S.bm25_part(F.col("idf"), both).alias("s"), S.bm25_part(F.col("idf"), weight("body")).alias("sb"), S.bm25_part(F.col("idf"), weight("title")).alias("st"),
            first("body").alias("fb"), first("title").alias("ft"),
        )
        if long:
            rows = rows.unionByName(self._phrases(hits), allowMissingColumns=True)
        g = rows.groupBy("qid", "doc_id").agg(
            F.collect_set("leaf").alias("got"), F.sum("s").alias("s"), F.sum("sb").alias("sb"), F.sum("st").alias("st"), F.count("s").alias("k"),
            F.sum("fb").alias("fb"), F.sum("ft").alias("ft"), F.min("fb").alias("fb_min"), F.min("ft").alias("ft_min"), F.max("title_len").alias("title_len"), F.max("body_len").alias("body_len"),
        )
        # each query has the number of its tree's shape; queries of one shape share one predicate
        shapes: dict[str, tuple[int, Node]] = {}
        shape_of = []
        for q, t in c.trees.items():
            shape_of.append((q, shapes.setdefault(numbered(t)[0], (len(shapes), t))[0]))
        true = F.lit(False)
        for number, t in shapes.values():
            true = F.when(F.col("_shape") == number, predicate(t, lambda i: F.array_contains("got", i))).otherwise(true)
        table = spark.createDataFrame(shape_of, "qid bigint, _shape int")
        return g.join(_few(table, len(shape_of)), "qid", "left").withColumn("_holds", true).drop("_shape", "got")

    def _absent(self, c: Compiled) -> set[int]:
        """Queries that match documents without any of their words."""
        return {q for q, t in c.trees.items() if holds(t, set())} | c.every

    def _found(self, c: Compiled, g: DataFrame, first: int | None = None) -> DataFrame:
        found, absent = g.where("_holds"), self._absent(c)
        if c.every:
            every = self._few_qids(c.every).withColumn("_every", F.lit(True))
            found = g.join(every, "qid", "left").where(F.col("_holds") | F.coalesce("_every", F.lit(False))).drop("_every")
        if not absent:
            return found.drop("_holds")
        # what such a query matches is the collection less the documents that hold its words: a table of that size, which
        # is what was asked for. Those without a word all score 0 and go by number, so the first n of them are among the
        # first n + m of the collection, m being the documents that hold a word.
        asked = self._few_qids(absent)
        docs = self.index.doc_stats
        if first is not None:
            most = g.join(asked, "qid").groupBy("qid").count().agg(F.max("count")).first()[0] or 0
            docs = docs.orderBy("doc_id").limit(first + most)
        rest = docs.join(asked).join(g.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")
        return found.drop("_holds").unionByName(rest, allowMissingColumns=True)

    def _few_qids(self, qids: set[int]) -> DataFrame:
        return _few(self.index.docs.sparkSession.createDataFrame([(q,) for q in sorted(qids)], "qid bigint"), len(qids))

    def totals(self, c: Compiled, g: DataFrame) -> DataFrame:
        """(qid, num_results)."""
        found = F.col("_holds") | F.col("qid").isin(sorted(c.every)) if c.every else F.col("_holds")
        counts = g.groupBy("qid").agg(F.count("*").alias("m"), F.count(F.when(found, 1)).alias("t"))
        absent = self._absent(c)
        if not absent:
            return counts.where("t > 0").select("qid", F.col("t").alias("num_results"))
        n = F.lit(int(self.stats["n"]))
        flag = self._few_qids(absent).withColumn("_absent", F.lit(True))
        both = flag.join(counts, "qid", "full").select("qid", (F.coalesce("t", F.lit(0)) + F.when(F.col("_absent"), n - F.coalesce("m", F.lit(0))).otherwise(F.lit(0))).cast("bigint").alias("num_results"))
        return both.where("num_results > 0")

    def _features(self, c: Compiled, found: DataFrame) -> DataFrame:
        spark, st = self.index.docs.sparkSession, self.stats
        n_words = spark.createDataFrame([(q, n) for q, n in c.n_words.items()] + [(q, 0) for q in c.every - set(c.n_words)], "qid bigint, n_words int")
        f = found.join(_few(n_words, len(c.qids)), "qid")
        mean = lambda x: F.when(F.col("n_words") > 0, (F.coalesce(x, F.lit(0.0)) + (F.col("n_words") - F.coalesce("k", F.lit(0)))) / F.col("n_words")).otherwise(F.lit(1.0))
        least = lambda x: F.coalesce(x, F.lit(1.0))
        share = lambda f: (F.col(f"{f}_len") / F.lit(float(st[f"max_{f}"]))) if st[f"max_{f}"] else F.lit(0.0)
        zero = lambda x: F.coalesce(x, F.lit(0.0))
        return f.select(
            "qid", "doc_id", zero("s").alias(FEATURES[0]), zero("sb").alias(FEATURES[1]), zero("st").alias(FEATURES[2]), mean("fb").alias(FEATURES[3]), mean("ft").alias(FEATURES[4]),
            least("fb_min").alias(FEATURES[5]), least("ft_min").alias(FEATURES[6]), share("body").alias(FEATURES[7]), share("title").alias(FEATURES[8]), (least("ft_min") < 1.0).cast("int").alias(FEATURES[9]),
        )

    @staticmethod
    def _phrases(hits: DataFrame) -> DataFrame:
        """(qid, doc_id, leaf) where the words of a phrase stand side by side in the body, or in the title."""
        back = lambda p: F.transform(p, lambda x: x - F.col("offset"))
        h = hits.where("n_phrase > 0").select("qid", "doc_id", "leaf", "n_phrase", "offset", back(F.col("pos_body")).alias("b"), back(F.col("pos_title")).alias("t"))
        # documents that hold all the words, before any positions are moved
        whole = h.groupBy("qid", "doc_id", "leaf").agg(F.count("*").alias("n"), F.first("n_phrase").alias("n_phrase")).where("n = n_phrase").select("qid", "doc_id", "leaf")
        g = h.join(whole, ["qid", "doc_id", "leaf"], "left_semi").groupBy("qid", "doc_id", "leaf").agg(F.collect_list(F.struct("b", "t")).alias("at"))
        meets = lambda f: F.size(F.aggregate(F.slice("at", 2, F.size("at")), F.get(F.col("at"), 0)[f], lambda a, x: F.array_intersect(a, x[f]))) > 0
        return g.where(meets("b") | meets("t")).select("qid", "doc_id", "leaf")

    @staticmethod
    def top(df: DataFrame, score: str, k: int, by: str = "qid") -> DataFrame:
        """The k rows of largest score (rounded to 9 places, so that equal sums tie), ties by doc_id, with their rank."""
        w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), F.col("doc_id"))
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def rank(self, c: Compiled, num_return: int = RETURNED, num_candidates: int = CANDIDATES, rerank: bool = True) -> DataFrame:
        """(qid, rank, score, doc_id, num_results, features)."""
        keep = num_candidates if self.ranker and rerank else min(num_candidates, num_return)
        if self._absent(c):
            g = cut(self._grouped(c))
            totals, found = self.totals(c, g), self._features(c, self._found(c, g, keep))
        else:
            best = self.best(c, keep)
            totals, found = best.select("qid", "num_results").distinct(), self.lexical(c, best)
        top = self.top(found, FEATURES[0], keep)
        if self.ranker and rerank:
            top = self.top(self.ranker(top.drop("rank")), "score", num_return)
        else:
            top = top.withColumn("score", F.col(FEATURES[0]))
        return top.join(totals, "qid").select("qid", "rank", "score", "doc_id", "num_results", *FEATURES)

    def search(
        self,
        queries: list[str] | list[tuple[int, str]] | DataFrame,
        mode: SearchMode | str = SearchMode.OR,
        num_return: int = RETURNED,
        num_candidates: int = CANDIDATES,
        snippet_length: int = SNIPPET,
        spelling: bool = True,
        idf_threshold: float | None = S.IDF_THRESHOLD,
        rerank: bool = True,
    ) -> DataFrame:
        """(qid, rank, score, doc_id, docid, url, title, body_snippet, num_results).

        queries: texts (numbered from 0), (qid, text) pairs, or a DataFrame (queryid, query) that holds one batch. A query
        that is malformed in the boolean language raises ValueError; an empty one has no rows."""
        mode = SearchMode(mode) if isinstance(mode, str) else mode
        batch = as_batch(queries)
        if mode is SearchMode.SEMANTIC:
            if self.dense is None:
                raise ValueError("the engine was opened without vectors")
            return self.fetch(self.dense.search(self, batch, num_return, rerank=rerank), snippet_length)
        return self.fetch(self.rank(self.compile(batch, mode, spelling, idf_threshold), num_return, num_candidates, rerank), snippet_length)

    def fetch(self, ranked: DataFrame, snippet_length: int = SNIPPET) -> DataFrame:
        """Joins the texts of ranked rows; the rows are written and broadcast if few."""
        r = cut(ranked.select("qid", "rank", "score", "doc_id", "num_results"))
        d = self.index.docs.join(_few(r, r.count()), "doc_id")
        return d.select("qid", "rank", "score", "doc_id", "docid", "url", "title", snippet(F.col("body"), snippet_length).alias("body_snippet"), "num_results")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has so few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def as_batch(queries: list[str] | list[tuple[int, str]] | DataFrame, most: int = MAX_BATCH) -> list[tuple[int, str]]:
    """(qid, text) pairs of one batch; more than `most` are refused, not cut: split them into batches."""
    if isinstance(queries, DataFrame):
        queries = [(r[0], r[1]) for r in queries.select("queryid", "query").limit(most + 1).collect()]
    if len(queries) > most:
        raise ValueError(f"a batch holds at most {most} queries")
    return [(i, q) if isinstance(q, str) or q is None else tuple(q) for i, q in enumerate(queries)]
