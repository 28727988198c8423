"""The queries of the ten problems, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import canonical, distinctive, encoding, fusion, nearduplicates, neighbours, overlap, packing, splits, vocabulary
from rankloom.llm.common import cut

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


RANKING_SCORES = {"bm25_score": 1, "bm25_score_title": 1, "body_length_norm": 1, "body_first_occurrence_mean": -1}


def _p1_found(s: SparkSession, d: str) -> DataFrame:
    return splits.found_groups(_t(s, d, "train_with_negatives"))


def _p1_splits(s: SparkSession, d: str) -> DataFrame:
    return splits.grouped_split(_t(s, d, "train_with_negatives"), _t(s, d, "split_plan"))


def _p1_balance(s: SparkSession, d: str) -> DataFrame:
    """For each split whether its share of the rows is within a hundredth of the plan's; and how many groups are in several splits."""
    table, plan = _t(s, d, "train_with_negatives"), _t(s, d, "split_plan").select("split_name", "share").distinct()
    new = cut(splits.grouped_split(table, plan))
    group = splits.related_groups(table).select("row_index", "group_key").join(new, "row_index").groupBy("group_key").agg(F.countDistinct("new_split").alias("n"))
    apart = group.agg(F.count(F.when(F.col("n") > 1, 1)).alias("groups_apart"))
    share = new.groupBy(F.col("new_split").alias("split_name")).agg(F.count("*").alias("n"))
    total = new.agg(F.count("*").alias("total"))
    near = F.abs(F.coalesce("n", F.lit(0)) / F.col("total") - F.col("share")) <= 0.01
    return plan.join(share, "split_name", "left").join(total).join(apart).select("split_name", near.alias("near"), "groups_apart")


def _p2_order(s: SparkSession, d: str) -> DataFrame:
    return fusion.ideal_point_ranking(_t(s, d, "train_with_negatives"), RANKING_SCORES).select("queryid", "row_index", "place")


def _p3_found(s: SparkSession, d: str) -> DataFrame:
    o = overlap.overlaps(_t(s, d, "train_with_negatives"))
    return o.select(F.least("train_row", "held_row").alias("row_index_a"), F.greatest("train_row", "held_row").alias("row_index_b"))


def _p3_classes(s: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_classes(_t(s, d, "train_with_negatives"))


def _p3_counts(s: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(_t(s, d, "train_with_negatives"))


def _scores(s: SparkSession, d: str, **options: int) -> DataFrame:
    q = _t(s, d, "train_with_negatives").select("row_index", "query")
    return distinctive.term_scores(_t(s, d, "msmarco_docs"), others=(("query", q, "row_index", "query"),), **options)


def _p4_found(s: SparkSession, d: str) -> DataFrame:
    """The scored words that TESTDATA.md counts as cases. They are told by counts; each has its score all the same."""
    telling = (F.col("df") <= 3) & ((F.col("field") == "query") | (F.col("tf") >= 3))
    return _scores(s, d).where(telling & F.col("score").isNotNull()).select("field", "record_key", "term").distinct()


def _p4_shared(s: SparkSession, d: str) -> DataFrame:
    """Scores of the words that at least three bodies hold."""
    return _scores(s, d, min_df=3).select("field", "record_key", "term", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def _p4_scores(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).select("field", "record_key", "term", (F.round("score", 6) + F.lit(0.0)).alias("score"))


def _p5_found(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.marked_terms(_t(s, d, "msmarco_docs")).where("mark != 'kept'").select("term", "mark")


def _p5_terms(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.marked_terms(_t(s, d, "msmarco_docs"))


def _p6_found(s: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(_t(s, d, "doc_vectors"))


def _p6_nearest(s: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_t(s, d, "doc_vectors"))


def _p7_found(s: SparkSession, d: str) -> DataFrame:
    p = nearduplicates.near_duplicate_pairs(_t(s, d, "msmarco_docs"), size=3, threshold=0.7)
    return p.select(F.col("id_a").alias("docid_a"), F.col("id_b").alias("docid_b"))


def _p7_groups(s: SparkSession, d: str) -> DataFrame:
    return nearduplicates.near_duplicate_groups(_t(s, d, "msmarco_docs"), size=3, threshold=0.7).withColumnRenamed("id", "docid")


def _p7_classes(s: SparkSession, d: str) -> DataFrame:
    return nearduplicates.class_links(_t(s, d, "msmarco_docs"), size=3, threshold=0.7).withColumn("similarity", F.round("similarity", 6))


def _p8_ids(s: SparkSession, d: str) -> DataFrame:
    return encoding.encode(_t(s, d, "documents"))


def _p9_containers(s: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(_t(s, d, "documents"))


def _p9_fill(s: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers: texts placed, tokens lost or doubled, containers above their capacity, texts cut
    that fit into one, and whether 95 hundredths of the room are used."""
    docs = _t(s, d, "documents")
    items, placed = cut(encoding.token_counts(docs)), cut(packing.pack_texts(docs))
    of = placed.groupBy("doc_id").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n"), F.count("*").alias("parts"))
    both = items.where("n_tokens > 0").join(of, "doc_id", "left").agg(
        F.count("n").alias("texts"), F.sum(F.abs(F.col("n_tokens") - F.coalesce("n", F.lit(0)))).alias("tokens_lost"),
        F.count(F.when(F.col("parts") > F.ceil(F.col("n_tokens") / 2048), 1)).alias("cut_in_vain"),
    )
    full = placed.groupBy("container").agg(F.sum(F.col("token_end") - F.col("token_start")).alias("n")).agg(F.count(F.when(F.col("n") > 2048, 1)).alias("overfull"), (F.avg("n") >= 0.95 * 2048).alias("full"))
    return both.join(full)


def _p10_found(s: SparkSession, d: str) -> DataFrame:
    p = canonical.same_looking_pairs(_t(s, d, "documents"))
    return p.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def _p10_forms(s: SparkSession, d: str) -> DataFrame:
    return canonical.canonical(_t(s, d, "documents"))


def queries() -> dict[str, Query]:
    return {
        "p1_found": _p1_found,
        "p1_splits": _p1_splits,
        "p1_balance": _p1_balance,
        "p2_order": _p2_order,
        "p3_found": _p3_found,
        "p3_classes": _p3_classes,
        "p3_counts": _p3_counts,
        "p4_found": _p4_found,
        "p4_scores": _p4_scores,
        "p4_shared": _p4_shared,
        "p5_found": _p5_found,
        "p5_terms": _p5_terms,
        "p6_found": _p6_found,
        "p6_nearest": _p6_nearest,
        "p7_found": _p7_found,
        "p7_groups": _p7_groups,
        "p7_classes": _p7_classes,
        "p8_ids": _p8_ids,
        "p9_containers": _p9_containers,
        "p9_fill": _p9_fill,
        "p10_found": _p10_found,
        "p10_forms": _p10_forms,
    }
