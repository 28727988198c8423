"""Filling fixed-capacity containers with items (problem 9)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import cut
from rankloom.llm.encoding import TOKENIZERS, token_counts


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: the first that has room, by a tournament tree whose inner nodes hold the most room below.

    Bins beyond those in use are empty leaves, so an item that fits nowhere opens the next one."""
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = []
    for s in sizes:
        i = 1
        while i < leaves:
            i *= 2
            if room[i] < s:
                i += 1
        out.append(i - leaves)
        room[i] -= s
        i //= 2
        while i:
            r = room[2 * i] if room[2 * i] > room[2 * i + 1] else room[2 * i + 1]
            if room[i] == r:
                break
            room[i] = r
            i //= 2
    return out


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", group_items: int = 20_000, seed: int = 17) -> DataFrame:
    """(container, place, id, token_start, token_end): items put into containers of `capacity`, first-fit decreasing.

    An item above the capacity is cut into full containers and a rest; no other is cut. Items fall into random groups of
    about group_items by a hash of id, size and place in the input, so repeated and null ids spread, and each group is packed by itself, so no task holds all; the containers
    of a group that stay part empty are few beside the thousands it fills. Container numbers are unique over groups;
    place counts from 0 in the order of falling size. Items of null, zero or negative size have no place; items of equal
    size go by id; repeated rows are items of their own; an empty table gives an empty result."""
    kind = items.schema[id_col].dataType.simpleString()
    spark = items.sparkSession
    x = cut(items.where(F.col(size_col) > 0).select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("n"), F.monotonically_increasing_id().alias("r")))
    schema = f"container bigint, place int, `{id_col}` {kind}, token_start bigint, token_end bigint"
    total = x.count()
    if not total:
        return spark.createDataFrame([], schema)
    groups = -(-total // group_items)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(pdf.g.iloc[0]) << 32
        n = pdf.n.to_numpy("int64")
        # pieces: full ones first, each a container of its own
        full = n // capacity
        rest = n % capacity
        whole = np.repeat(np.arange(len(n)), full)
        nth = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        part = np.flatnonzero(rest)
        order = part[np.lexsort((pdf.id.to_numpy()[part], -rest[part]))] if len(part) else part
        bins = np.array(first_fit(rest[order].tolist(), capacity), "int64") + len(whole)
        item = np.concatenate([whole, order])
        start = np.concatenate([nth * capacity, full[order] * capacity]).astype("int64")
        end = np.concatenate([(nth + 1) * capacity, n[order]]).astype("int64")
        out = pd.DataFrame({"container": np.concatenate([np.arange(len(whole)), bins]).astype("int64") + g, id_col: pdf.id.to_numpy()[item], "token_start": start, "token_end": end})
        out["place"] = out.groupby("container", sort=False).cumcount().astype("int32")
        return out[["container", "place", id_col, "token_start", "token_end"]]

    g = F.pmod(F.xxhash64(F.lit(seed), "id", "n", "r"), F.lit(groups))
    return x.withColumn("g", g).groupBy("g").applyInPandas(run, schema)


def pack_texts(df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", **options: int) -> DataFrame:
    """pack() over the texts' sizes in tokens. Null and empty texts have no tokens and no place; blank ones have."""
    return pack(token_counts(df, id_col, text_col, path), capacity, id_col, **options)
