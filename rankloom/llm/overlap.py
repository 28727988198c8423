"""Same or near-same records across splits (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import clean_id, cut, sent, spread, words

MAX_EDITS, EDIT_SHARE = 3, 5  # at most three edits and at most a fifth of the longer text
WEIGHT_BITS = 53  # a term is a number: its weight above so many bits of hash, so the heaviest come first in falling order
MOST_WEIGHT = 1000


def edits(n: int) -> int:
    return min(MAX_EDITS, n // EDIT_SHARE)


def partner_lengths(n: int) -> list[int]:
    return [m for m in range(max(1, n - MAX_EDITS), n + MAX_EDITS + 1) if abs(n - m) <= edits(max(n, m))]


#: The most edits between a text of n characters and any partner; MAX_EDITS for longer ones.
_MOST = np.array([max([edits(max(n, m)) for m in partner_lengths(n)], default=0) for n in range(MAX_EDITS * EDIT_SHARE + 1)])


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, code) of each pair of adjacent characters of the blank-padded texts."""
    cp = np.frombuffer("".join(f" {q} " for q in texts).encode("utf-32-le"), "<u4").astype("int64")
    size = np.array([len(q) + 2 for q in texts], "int64")
    at = np.repeat(np.arange(len(texts)), size)
    inside = np.ones(len(cp), bool)
    inside[np.cumsum(size) - 1] = False
    first = np.flatnonzero(inside)
    return at[first], (cp[first] << 21) | cp[first + 1]


def _counts(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        code, n = np.unique(_pairs(pdf.text.tolist())[1], return_counts=True)
        yield pd.DataFrame({"code": code, "n": n})


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    h = x.astype("uint64") * np.uint64(by)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def vectors(texts: list[str], known: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    """A row for each text: n characters; terms, heaviest first; total weight w; lost[k], the most weight that k edits can
    take; prefix and rest, the terms to list and the weight after each; m1 and m2, two 64-bit marks of the terms.

    A term is a pair of adjacent characters and how often it came before in the text. The square of its weight in a vector
    is its idf, scaled to whole numbers: that of `known` pairs in `weight`, the greatest for all others; a later
    occurrence weighs a little more. Equal terms weigh the same in all vectors, so a dot product is the sum over common terms."""
    with np.errstate(over="ignore"):
        at, code = _pairs(texts)
        order = np.lexsort((code, at))
        at, code = at[order], code[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (code[1:] != code[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
        nth = np.arange(len(code)) - start
        w = np.full(len(code), MOST_WEIGHT - 60)
        if len(known):
            i = np.minimum(np.searchsorted(known, code), len(known) - 1)
            w = np.where(known[i] == code, weight[i], w)
        w = np.minimum(w + 12 * np.minimum(nth, 5), MOST_WEIGHT).astype("int64")
        hashed = _mixed(code * 31 + nth, 0x9E3779B97F4A7C15)
        term = (w << WEIGHT_BITS) | (hashed >> np.uint64(64 - WEIGHT_BITS)).astype("int64")
        marks = [np.uint64(1) << (_mixed(term, by) >> np.uint64(58)) for by in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
    order = np.lexsort((-term, at))
    term, w, at = term[order], w[order], at[order]
    marks = [m[order] for m in marks]
    size = np.array([len(q) + 1 for q in texts], "int64")
    ends = np.cumsum(size)
    starts = ends - size
    run = np.cumsum(w) - np.repeat(np.r_[0, np.cumsum(w)][starts], size)  # weight up to and with this term
    total = run[ends - 1]
    n = size - 1
    most = _MOST[np.minimum(n, len(_MOST) - 1)]
    lost = np.stack([np.zeros(len(n), "int64"), *(run[np.minimum(starts + 2 * k, ends) - 1] for k in range(1, MAX_EDITS + 1))], axis=1)
    # the terms after the prefix weigh less together than the least dot product, total - lost[most]
    prefix = np.minimum(2 * most + 1, size)
    cutoff = starts + prefix
    return pd.DataFrame(
        {
            "n": n.astype("int32"), "w": total, "lost": list(lost), "terms": np.split(term, ends[:-1]), "prefix": [term[a:b] for a, b in zip(starts, cutoff)],
            "rest": [t - run[a:b] for t, a, b in zip(total, starts, cutoff)], "m1": np.bitwise_or.reduceat(marks[0], starts).astype("int64"), "m2": np.bitwise_or.reduceat(marks[1], starts).astype("int64"),
        }
    )


def cosine_join(forms: DataFrame, known_terms: int = 4096) -> DataFrame:
    """(group, text_a, text_b, cosine): pairs of different texts of one group, a on the left side (`left` true), b on the
    right (`right` true), whose weighted vectors have at least the dot product that the rule of few edits leaves them.

    forms(group, text, left, right) holds each text of a group once, no text being empty; see vectors() for the terms. An
    edit touches at most two pairs of characters of either text, and an order of words none, so the dot product of two
    texts k edits apart is at least the weight of either less that of its 2k heaviest terms. By that bound only the
    heaviest (rarest) 2k + 1 terms of a vector go into the inverted lists, which are kept apart by group and text length:
    what stands after them could not reach it, each term's weight being the greatest it has in any vector. Where two
    meet in a list, the weight of the term and what is left after it in the lighter of the two residuals bounds the dot
    product, and two 64-bit marks of the terms bound how many can differ; pairs beyond either bound are dropped. All
    others are verified by their exact dot product.

    idf comes from counts over all texts, combined by batch; those of the known_terms most frequent pairs are broadcast,
    all rarer ones weigh most. Lists carry numbers of texts, not texts; hot ones are split by adaptive execution."""
    spark = forms.sparkSession
    forms = spread(cut(forms.select("group", "text", "left", "right")))
    by_pair = forms.select("text").mapInPandas(_counts, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    by_pair = cut(by_pair)
    total = by_pair.agg(F.sum("n")).first()[0] or 0
    top = sorted((r["code"], r["n"]) for r in by_pair.orderBy(F.desc("n"), "code").limit(known_terms).collect())
    known, count = np.array([x[0] for x in top], "int64"), np.array([x[1] for x in top], "f8")
    weight = np.clip(np.round(64 * np.log(1 + total / np.maximum(count, 1))), 1, MOST_WEIGHT - 60).astype("int64")
    sent_terms = spark.sparkContext.broadcast((known, weight))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pd.concat([pdf.reset_index(drop=True), vectors(pdf.text.tolist(), *sent_terms.value)], axis=1)

    schema = "group string, text string, left boolean, right boolean, n int, w bigint, lost array<bigint>, terms array<bigint>, prefix array<bigint>, rest array<bigint>, m1 bigint, m2 bigint"
    v = spread(cut(forms.mapInPandas(run, schema).withColumn("id", F.monotonically_increasing_id())))
    near = F.filter(F.sequence(F.greatest(F.lit(1), F.col("n") - MAX_EDITS), F.col("n") + MAX_EDITS), lambda m: F.abs(m - F.col("n")) <= F.least(F.lit(MAX_EDITS), F.floor(F.greatest(m, "n") / EDIT_SHARE)))
    cols = ("id", "n", "w", "lost", "m1", "m2")
    side = lambda x, *more: v.select("group", *[F.col(c).alias(f"{c}_{x}") for c in cols], *more, F.explode(F.arrays_zip(F.col("prefix").alias("t"), F.col("rest").alias("r"))).alias("z")).withColumn("term", F.col("z.t")).withColumn(f"r_{x}", F.col("z.r")).drop("z")
    a = side("a", "left", F.col("n").alias("band")).where("left").drop("left")
    b = side("b", "right", near.alias("bands")).where("right").withColumn("band", F.explode("bands")).drop("bands", "right")
    most = F.least(F.lit(MAX_EDITS), F.floor(F.greatest("n_a", "n_b") / EDIT_SHARE)).cast("int")
    needed = lambda: F.greatest(F.col("w_a") - F.get("lost_a", most), F.col("w_b") - F.get("lost_b", most))
    differ = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 4 * most
    bound = F.shiftright("term", WEIGHT_BITS) + F.least("r_a", "r_b")
    met = a.join(b, ["group", "term", "band"]).where(differ("m1_a", "m1_b") & differ("m2_a", "m2_b") & (bound >= needed()) & (F.col("id_a") != F.col("id_b")))
    cand = sent(cut(met.select("id_a", "id_b").distinct()))
    whole = lambda x: v.select(*[F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "w", "lost", "terms", "text")], *(["group"] if x == "a" else []))
    dot = F.aggregate(F.array_intersect("terms_a", "terms_b"), F.lit(0).cast("bigint"), lambda s, t: s + F.shiftright(t, WEIGHT_BITS))
    got = whole("b").join(whole("a").join(cand, "id_a"), "id_b").withColumn("dot", dot).where(F.col("dot") >= needed())
    return got.select("group", "text_a", "text_b", (F.col("dot") / F.sqrt(F.col("w_a").cast("double") * F.col("w_b"))).alias("cosine"))


def nearly_same(a: Column, b: Column) -> Column:
    """Equal, the same words equally often, or few edits apart."""
    same_words = F.array_sort(F.split(a, " ")) == F.array_sort(F.split(b, " "))
    return (a == b) | same_words | ((F.levenshtein(a, b) <= MAX_EDITS) & (F.levenshtein(a, b) * EDIT_SHARE <= F.greatest(F.length(a), F.length(b))))


class _Sides:
    """The records of both sides that share a docid, and the pairs of nearly equal texts of a docid."""

    def __init__(self, df: DataFrame, row_id: str, doc_id: str, query_id: str, query: str, split: str, train: str, held: tuple[str, ...]) -> None:
        q = F.array_join(words(F.col(query)), " ")
        r = df.select(F.col(row_id).alias("_r"), clean_id(F.col(doc_id)).alias("group"), F.col(query_id).alias("_q"), q.alias("text"), (F.col(split) == train).alias("left"), F.col(split).isin(*held).alias("right"))
        r = cut(r.where("group is not null and (left or right)").distinct())
        both = r.groupBy("group").agg(F.max("left").alias("l"), F.max("right").alias("r")).where("l and r").select("group")
        r = cut(r.join(both, "group"))
        self.left = r.where("left").select("group", F.col("_r").alias("train_row"), "_q", "text")
        self.right = r.where("right").select("group", F.col("_r").alias("held_row"), "_q", "text")
        forms = r.where("text != ''").groupBy("group", "text").agg(F.max("left").alias("left"), F.max("right").alias("right"))
        # written first: else the planner would check each candidate before its dot product is known
        self.close = cut(cosine_join(forms)).where(nearly_same(F.col("text_a"), F.col("text_b"))).select("group", "text_a", "text_b")


def overlaps(df: DataFrame, row_id: str = "row_index", doc_id: str = "docid", query_id: str = "queryid", query: str = "query", split: str = "split", train: str = "train", held: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(train_row, held_row, kind): a record of the training split and one of a held-out split with the same clean docid
    that have the same query id (kind `id`), the same words in order (`text`), or nearly the same text (`near`); a pair
    that is so in several ways has the first of them.

    Null and blank docids, null query ids, and queries without words equal nothing; records of other or no split take no
    part; repeated rows give their pair once; other columns are ignored; an empty table gives an empty result. Texts
    that come again, however often, are compared once for each docid. Every pair of records is written; see
    overlap_classes for a result that doesn't grow with the copies of a text."""
    s = _Sides(df, row_id, doc_id, query_id, query, split, train, held)
    left, right = s.left, s.right
    by_id = left.where("_q is not null").join(right.select("group", "held_row", "_q"), ["group", "_q"]).select("train_row", "held_row", F.lit(1).alias("way"))
    by_text = left.where("text != ''").join(right.select("group", "held_row", "text"), ["group", "text"]).select("train_row", "held_row", F.lit(2).alias("way"))
    by_near = (
        s.close.join(left.select("group", F.col("text").alias("text_a"), "train_row"), ["group", "text_a"])
        .join(right.select("group", F.col("text").alias("text_b"), "held_row"), ["group", "text_b"])
        .select("train_row", "held_row", F.lit(3).alias("way"))
    )
    ways = by_id.unionByName(by_text).unionByName(by_near).groupBy("train_row", "held_row").agg(F.min("way").alias("way"))
    return ways.select("train_row", "held_row", F.element_at(F.array(F.lit("id"), F.lit("text"), F.lit("near")), F.col("way")).alias("kind"))


def overlap_classes(df: DataFrame, row_id: str = "row_index", doc_id: str = "docid", query_id: str = "queryid", query: str = "query", split: str = "split", train: str = "train", held: tuple[str, ...] = ("val", "test")) -> DataFrame:
    """(docid, kind, train_key, held_key, train_records, held_records): the links of overlaps() between classes of
    records, those of one clean docid and one query id (kind `id`) or one text (`text`, `near`), with the classes' sizes."""
    s = _Sides(df, row_id, doc_id, query_id, query, split, train, held)
    count = lambda d, c, x: d.groupBy("group", F.col(c).alias(f"{x}_key")).agg(F.count("*").alias(f"{x}_records"))
    id_a, id_b = (count(d.where("_q is not null").withColumn("_q", F.col("_q").cast("string")), "_q", x) for d, x in ((s.left, "train"), (s.right, "held")))
    text_a, text_b = (count(d.where("text != ''"), "text", x) for d, x in ((s.left, "train"), (s.right, "held")))
    same = lambda a, b, kind: a.join(b.withColumn("train_key", F.col("held_key")), ["group", "train_key"]).withColumn("kind", F.lit(kind))
    near = s.close.withColumnsRenamed({"text_a": "train_key", "text_b": "held_key"}).join(text_a, ["group", "train_key"]).join(text_b, ["group", "held_key"]).withColumn("kind", F.lit("near"))
    out = same(id_a, id_b, "id").unionByName(same(text_a, text_b, "text")).unionByName(near)
    return out.select(F.col("group").alias("docid"), "kind", "train_key", "held_key", "train_records", "held_records")


def overlap_counts(df: DataFrame, row_id: str = "row_index", split: str = "split", source: str = "source", **cols: str) -> DataFrame:
    """(split, source, records, pairs): the held-out records that overlap with training records, and those pairs, by the
    held-out record's split and source (null is a source of its own)."""
    o = overlaps(df, row_id, split=split, **cols).groupBy("held_row").agg(F.count("*").alias("pairs"))
    at = df.select(F.col(row_id).alias("held_row"), F.col(split).alias("split"), F.col(source).alias("source")).distinct()
    return o.join(at, "held_row").groupBy("split", "source").agg(F.countDistinct("held_row").alias("records"), F.sum("pairs").alias("pairs"))
