"""Learning-to-rank data: judged pairs, negatives by rank, offline features, splits, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import scoring as S
from rankloom.functions.text import tokens
from rankloom.operators.search import FEATURES
from rankloom.session import cut

# The ranks that the training data takes its negatives from.
NEAR_RANKS = [1, 2, 3, 4, 5, 6]
FAR_RANKS = [95, 96, 97, 98, 99, 100]
TRAIN_RANKS = NEAR_RANKS + FAR_RANKS
DEV_RANKS = list(range(1, 101))


def judged_pairs(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """qrels with their query's and document's text: two inner equi-joins; the planner broadcasts a side that is small."""
    return qrels.join(docs, "docid").join(queries, "queryid")


def filter_ranks(run: DataFrame, near: int = 6, far: int = 94, rank: str = "rank") -> DataFrame:
    return run.where((F.col(rank) <= near) | (F.col(rank) > far))


def pivot_ranks(run: DataFrame, ranks: list[int], rank: str = "rank") -> DataFrame:
    """(queryid, "1", "2", ...): the docid at each rank; of several the smallest. The values are given, so no extra pass."""
    return run.groupBy("queryid").pivot(rank, ranks).agg(F.min("docid"))


def match_rank(ranks: list[int], docid: str = "docid") -> Column:
    """The first rank whose docid is the positive one; null if none is."""
    return F.coalesce(*[F.when(F.col(f"`{r}`") == F.col(docid), F.lit(r)) for r in ranks])


def with_negatives(pairs: DataFrame, run: DataFrame, ranks: list[int]) -> DataFrame:
    """pairs ⋈ the run in wide form, with the columns of each rank and `match`. Queries without a run drop out."""
    return pairs.join(pivot_ranks(run.where(F.col("rank").isin(ranks)), ranks), "queryid").withColumn("match", match_rank(ranks))


def number_rows(df: DataFrame, by: list[str], name: str = "index") -> DataFrame:
    """Dense row numbers from 0 in the order of `by`, without a global sort in one task."""
    from rankloom.sources.readers import dense_index

    return dense_index(df, by, name)


def negatives_long(wide: DataFrame, ranks: list[int], keep: list[str]) -> DataFrame:
    """(keep..., neg_rank, neg_docid): one unpivot in place of a join for each rank; absent ranks give no row."""
    pairs = F.array(*[F.struct(F.lit(r).alias("neg_rank"), F.col(f"`{r}`").alias("neg_docid")) for r in ranks])
    return wide.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.neg_rank", "x.neg_docid").where("neg_docid is not null")


def fetch_negatives(long: DataFrame, docs: DataFrame) -> DataFrame:
    """The negatives' texts by one join."""
    d = docs.select(F.col("docid").alias("neg_docid"), F.col("url").alias("neg_url"), F.col("title").alias("neg_title"), F.col("body").alias("neg_body"))
    return long.join(d, "neg_docid")


def widen(base: DataFrame, long: DataFrame, ranks: list[int], values: list[str], key: str = "index") -> DataFrame:
    """base with a column `{value}_{rank}` for each value and rank: one aggregation and one join in place of a chain."""
    aggs = [F.max(F.when(F.col("neg_rank") == r, F.col(v))).alias(f"{v}_{r}") for r in ranks for v in values]
    return base.join(long.groupBy(key).agg(*aggs), key)


def select_negatives(long: DataFrame, n: int = 10, rank: str = "neg_rank", match: str = "match") -> DataFrame:
    """The n negatives of each sample: the first n / 2 near ranks and the last n / 2 far ranks, the rank at which the
    positive itself stands being left out and its side filled up by the next one."""
    half = n // 2
    r, m = F.col(rank), F.coalesce(F.col(match).cast("int"), F.lit(0))
    near_hit, far_hit = m.between(1, half + 1), m > F.lit(half + 1)
    near = (r <= half + F.when(near_hit, 1).otherwise(0)) & ~(near_hit & (r == m))
    far = (r > 100 - half - F.when(far_hit, 1).otherwise(0)) & ~(far_hit & (r == m))
    return long.where(near | far)


def select_dev_negatives(long: DataFrame, n: int = 100, rank: str = "neg_rank") -> DataFrame:
    """The n candidates of a development sample: ranks 1 to n, the positive's own rank among them."""
    return long.where(F.col(rank).between(1, n))


def random_split(df: DataFrame, key: str, cuts: tuple[float, ...] = (0.8, 0.9), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 42, out: str = "split") -> DataFrame:
    """Rows in the order of a seeded digest of their key, cut at int(n * cut): exact sizes, the same at every run."""
    order = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    numbered = number_rows(df.withColumn("_h", order), ["_h", key], "_i")
    n = df.count()
    split = F.lit(names[-1])
    for c, name in reversed(list(zip(cuts, names))):
        split = F.when(F.col("_i") < int(n * c), name).otherwise(split)
    return numbered.withColumn(out, split).drop("_i", "_h")


# --- offline features ------------------------------------------------------------------------------------------------


def offline_features(pairs: DataFrame, postings: DataFrame, doc_stats: DataFrame, terms: DataFrame, stats: dict[str, float], keep: list[str]) -> DataFrame:
    """(keep..., ten features) of pairs(doc_id, query), from the index's tables.

    terms(term, idf); an unknown word has idf 0 and, like any word of idf 0, adds no score. Lengths are relative to the
    longest document of these pairs. Query words are exploded and meet the postings by document and term, so no text
    travels, none is split again, and a document that many pairs name is spread by their words."""
    p = cut(number_rows(pairs.select(*keep, "doc_id", "query"), keep, "_row"))
    first = lambda c, n: F.coalesce(F.get(F.col(c), 0) / F.col(n), F.lit(1.0))
    found = postings.select("doc_id", F.col("term").alias("w"), F.col("tf_title").alias("tt"), F.col("tf_body").alias("tb"), first("pos_title", "title_len").alias("ft"), first("pos_body", "body_len").alias("fb"), F.col("title_len").alias("tl"), F.col("body_len").alias("bl"))
    w = p.select("_row", "doc_id", F.explode(tokens(F.col("query"))).alias("w")).join(found, ["doc_id", "w"], "left")
    # of a word that the document lacks nothing but its place in the mean counts
    w = w.fillna(0, ["tt", "tb", "tl", "bl"]).fillna(1.0, ["ft", "fb"])
    w = w.join(terms.select(F.col("term").alias("w"), "idf"), "w", "left").withColumn("idf", F.coalesce("idf", F.lit(0.0)))
    wb = S.term_weight(F.col("tb"), F.col("bl"), F.lit(float(stats["avg_body"] or 0)))
    wt = S.term_weight(F.col("tt"), F.col("tl"), F.lit(float(stats["avg_title"] or 0)))
    part = lambda x: F.when(F.col("idf") != 0, S.bm25_part(F.col("idf"), x)).otherwise(F.lit(0.0))
    g = w.groupBy("_row").agg(
        F.sum(part(wb + S.TITLE_WEIGHT * wt)).alias(FEATURES[0]), F.sum(part(wb)).alias(FEATURES[1]), F.sum(part(wt)).alias(FEATURES[2]), F.avg("fb").alias(FEATURES[3]), F.avg("ft").alias(FEATURES[4]),
        F.min("fb").alias(FEATURES[5]), F.min("ft").alias(FEATURES[6]), F.max((F.col("ft") < 1.0).cast("int")).alias(FEATURES[9]),
    )
    lengths = p.select("_row", "doc_id").join(doc_stats.select("doc_id", F.col("title_len").alias("tl"), F.col("body_len").alias("bl")), "doc_id").drop("doc_id")
    most = lengths.agg(F.max("tl"), F.max("bl")).first()
    share = lambda c, m: F.col(c) / F.lit(float(m)) if m else F.lit(0.0)
    out = p.select("_row", *keep).join(lengths, "_row").join(g, "_row", "left")
    none = dict(zip(FEATURES, (0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, None, None, 0)))
    cols = [share("bl", most[1]).alias(f) if f == FEATURES[7] else share("tl", most[0]).alias(f) if f == FEATURES[8] else F.coalesce(f, F.lit(none[f])).alias(f) for f in FEATURES]
    return out.select(*keep, *cols)


def fill_norms(df: DataFrame, suffixes: list[str] = [""]) -> DataFrame:  # noqa: B006
    """Null length norms become 0."""
    return df.fillna(0.0, [f"{f}{s}" for f in (FEATURES[7], FEATURES[8]) for s in suffixes])


def samples(df: DataFrame, id_col: str, positive: Column) -> DataFrame:
    """(id, label, features array<double>) in long form."""
    return df.select(id_col, positive.cast("int").alias("label"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES]).alias("features"))


# --- evaluation ------------------------------------------------------------------------------------------------------


def positive_rank(scored: DataFrame, by: str, score: str = "score", label: str = "label") -> DataFrame:
    """(by, rank): 1 + the number of the list's scores above the positive's; the positive wins ties."""
    pos = scored.where(F.col(label) == 1).groupBy(by).agg(F.max(score).alias("_p"))
    above = F.count(F.when((F.col(score) > F.col("_p")) & (F.col(label) != 1), 1))
    return scored.join(pos, by).groupBy(by).agg((above + 1).alias("rank"))


def evaluate(scored: DataFrame, by: str, k: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """One row: n lists, mean reciprocal rank and mean nDCG at k."""
    return positive_rank(scored, by, score, label).agg(F.count("*").alias("n"), F.avg(S.mrr(F.col("rank"), k)).alias("mrr"), F.avg(S.ndcg(F.col("rank"), k)).alias("ndcg"))


def listwise_loss(scored: DataFrame, by: str, score: str = "score", label: str = "label", twice: bool = True) -> DataFrame:
    """(by, loss): cross entropy of the list's positive. `twice` applies the softmax to scores that are softmaxed already;
    without it this is the plain listwise loss."""
    w = Window.partitionBy(by)
    x = scored.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w))).withColumn("_p", F.col("_e") / F.sum("_e").over(w))
    if not twice:
        return x.where(F.col(label) == 1).groupBy(by).agg(F.sum(-F.ln("_p")).alias("loss"))
    x = x.withColumn("_x", F.exp("_p")).withColumn("_q", F.col("_x") / F.sum("_x").over(w))
    return x.where(F.col(label) == 1).groupBy(by).agg(F.sum(-F.ln("_q")).alias("loss"))


def batches(df: DataFrame, key: str, size: int = 64, seed: int | None = None) -> DataFrame:
    """df with the column batch: rows in the order of the key, or of a seeded digest of it, `size` a batch."""
    order = F.col(key) if seed is None else F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return number_rows(df.withColumn("_o", order), ["_o", key], "_i").withColumn("batch", F.floor(F.col("_i") / size)).drop("_o", "_i")
