"""Splits that keep related records together (problem 1)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import clean_id, cut
from rankloom.llm.components import connected_components


def related_groups(df: DataFrame, row_id: str = "row_index", query_id: str = "queryid", doc_id: str = "docid", **_: object) -> DataFrame:
    """(row_id, group_key, group_docid): the group of records that share a queryid or a clean docid, also by way of others.

    Each queryid ties its docids to the smallest of them, so the graph has docids for nodes and at most a link a record.
    Null queryids and null or blank docids tie nothing; a record with neither is a group by itself. group_docid is the
    smallest clean docid of the group, null where the group has none. Repeated rows give repeated result rows; other
    columns are ignored; an empty table gives an empty result."""
    r = df.select(F.col(row_id).alias("_r"), F.col(query_id).cast("string").alias("_q"), clean_id(F.col(doc_id)).alias("_d"))
    tied = r.where("_q is not null and _d is not null").groupBy("_q").agg(F.min("_d").alias("_m"))
    links = r.where("_d is not null").join(tied, "_q").select("_d", "_m").distinct()
    comp = connected_components(links, "_d", "_m").select(F.col("node").alias("_d"), F.col("component").alias("_c"))
    tied = tied.join(comp.withColumnRenamed("_d", "_m"), "_m", "left").select("_q", F.coalesce("_c", "_m").alias("_qc"))
    g = r.join(comp, "_d", "left").join(tied, "_q", "left")
    doc = F.coalesce("_c", "_d", "_qc")
    key = F.coalesce(F.concat(F.lit("d:"), doc), F.concat(F.lit("q:"), "_q"), F.concat(F.lit("r:"), F.col("_r").cast("string")))
    return g.select(F.col("_r").alias(row_id), key.alias("group_key"), doc.alias("group_docid"))


def found_groups(df: DataFrame, row_id: str = "row_index", **cols: str) -> DataFrame:
    """(row_id, group_docid) of the records in groups of at least two records."""
    g = cut(related_groups(df, row_id, **cols).distinct())
    many = g.groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return g.join(many, "group_key").select(row_id, "group_docid")


def stratify(counts: np.ndarray, need: np.ndarray, outstanding: np.ndarray | None = None) -> np.ndarray:
    """Iterative stratification of groups: counts[g, l] rows of label l in group g, column 0 holding all rows;
    need[s, l] rows that split s still wants. Gives the split of each group and lowers `need` in place.

    The label with the fewest rows outstanding goes first, by `outstanding` where these groups are not all there are;
    its groups, largest first, go to the split that needs the label most, then to the one that needs most rows, then to
    the first; a split that has all its rows takes no more while another has not."""
    n, labels = counts.shape
    out = np.full(n, -1)
    left = (counts.sum(axis=0) if outstanding is None else outstanding).astype(float)
    open_ = np.ones(n, bool)
    here = counts.sum(axis=0)
    while open_.any():
        live = [x for x in range(1, labels) if here[x] > 0]
        lab = min(live, key=lambda x: (left[x], x)) if live else 0
        mine = np.flatnonzero(open_ & (counts[:, lab] > 0)) if live else np.flatnonzero(open_)
        mine = mine[np.lexsort((mine, -counts[mine, 0], -counts[mine, lab]))]
        for g in mine:
            s = max(range(need.shape[0]), key=lambda x: (need[x, 0] > 0, need[x, lab], need[x, 0], -x))
            out[g] = s
            need[s] -= counts[g]
        open_[mine] = False
        gone = counts[mine].sum(axis=0)
        left, here = left - gone, here - gone
        here[lab] = 0
    return out


def grouped_split(
    df: DataFrame,
    plan: DataFrame,
    row_id: str = "row_index",
    labels: tuple[str, ...] = ("rel", "source"),
    heavy_share: int = 1000,
    cell_groups: int = 20_000,
    max_values: int = 64,
    out: str = "new_split",
    **cols: str,
) -> DataFrame:
    """(row_id, new_split): every group of related_groups in one split, in the shares of plan(split_name, share), with the
    values of the label columns (null is a value) spread alike.

    Grouped iterative stratification: the label with the fewest rows outstanding in the whole collection goes first, and
    its groups, largest first, to the split that needs it most. This is done twice over: once for the groups of more than
    1/heavy_share of all rows (fewer than heavy_share of them), on the driver, as they alone can move a share; then for
    all others, which fall by hash of their key into cells of about cell_groups groups, each cell being taken by itself
    towards its part of what is still needed, in the same order of labels. Only groups of more than half of the smallest
    split come before all others, the largest first, whatever their labels: no later group could make up for them. Label columns of more than max_values
    distinct values are hashed into max_values, and values that meet there are spread alike only together. Shares that don't add up to 1 are scaled. An empty table gives an empty result."""
    spark = df.sparkSession
    shares = sorted(((r["split_name"], float(r["share"] or 0)) for r in plan.select("split_name", "share").distinct().limit(1000).collect()), key=lambda x: (-x[1], x[0]))
    names, share = [x[0] for x in shares], np.array([x[1] for x in shares])
    share = share / share.sum()
    row_labels = df.select(F.col(row_id).alias("_r"), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"_l{i}") for i, c in enumerate(labels)])
    groups = cut(related_groups(df, row_id, **cols).select(F.col(row_id).alias("_r"), "group_key"))
    pair = row_labels.groupBy("_r").agg(*[F.min(f"_l{i}").alias(f"_l{i}") for i in range(len(labels))])
    few = [pair.where(F.col(f"_l{i}") != "\0null").select(f"_l{i}").distinct().limit(max_values + 1).count() <= max_values for i in range(len(labels))]
    value = lambda i: F.col(f"_l{i}") if few[i] else F.pmod(F.xxhash64(f"_l{i}"), F.lit(max_values)).cast("string")
    long = groups.join(pair, "_r").select("group_key", F.explode(F.array(F.lit("*"), *[F.concat(F.lit(f"{i}:"), F.when(F.col(f"_l{i}") == "\0null", "null").otherwise(F.concat(F.lit("="), value(i)))) for i in range(len(labels))])).alias("label"))
    vec = cut(long.groupBy("group_key", "label").agg(F.count("*").alias("n")))
    totals = {r["label"]: r["n"] for r in vec.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    rows = totals.get("*", 0)
    if not rows:
        return groups.select(F.col("_r").alias(row_id), F.lit(None).cast("string").alias(out))
    order = ["*", *sorted(x for x in totals if x != "*")]
    col = {x: i for i, x in enumerate(order)}
    heavy_keys = vec.where((F.col("label") == "*") & (F.col("n") * heavy_share > rows)).select("group_key")
    heavy = vec.join(heavy_keys, "group_key").toPandas()
    need = share[:, None] * np.array([totals[x] for x in order], float)[None, :]
    placed: list[tuple[str, str]] = []
    if len(heavy):
        keys = sorted(heavy.group_key.unique())
        m = np.zeros((len(keys), len(order)))
        m[heavy.group_key.map({k: i for i, k in enumerate(keys)}), heavy.label.map(col)] = heavy.n
        left = np.array([totals[x] for x in order], float)
        where, giant = np.full(len(keys), -1), m[:, 0] > need[need[:, 0] > 0, 0].min() / 2
        for g in sorted(np.flatnonzero(giant), key=lambda g: (-m[g, 0], g)):
            where[g] = stratify(m[g : g + 1], need, left)[0]
            left -= m[g]
        where[~giant] = stratify(m[~giant], need, left)
        placed = [(k, names[i]) for k, i in zip(keys, where)]
    heavy_out = spark.createDataFrame(placed or [("", "")], "group_key string, split string").where("group_key != ''")
    light = vec.join(heavy_keys, "group_key", "left_anti")
    sums = {r["label"]: r["n"] for r in light.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n_light = light.where(F.col("label") == "*").count()
    outstanding = np.array([sums.get(x, 0) for x in order], float)
    open_need = np.maximum(need, 0)
    want = open_need / np.maximum(open_need.sum(axis=0), 1e-9)

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        code, keys = pd.factorize(pdf.group_key, sort=True)
        m = np.zeros((len(keys), len(order)))
        m[code, pdf.label.map(col)] = pdf.n
        s = stratify(m, want * m.sum(axis=0)[None, :], outstanding)
        return pd.DataFrame({"group_key": keys, "split": [names[i] for i in s]})

    cells = max(1, -(-n_light // cell_groups))
    light_out = light.withColumn("cell", F.pmod(F.xxhash64("group_key"), F.lit(cells))).groupBy("cell").applyInPandas(cell, "group_key string, split string")
    where = cut(light_out).unionByName(heavy_out)
    return groups.join(where, "group_key").select(F.col("_r").alias(row_id), F.col("split").alias(out))
