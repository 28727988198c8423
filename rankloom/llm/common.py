"""What several operators of this subpackage share: words, clean ids, classes of copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.session import cut, discard, spread

WORD = r"[\p{L}\p{N}]+"
#: What counts as white space around an id, also in Python's str.strip().
SPACES = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

__all__ = ["SPACES", "WORD", "all_pairs", "clean_id", "cut", "discard", "gathered_by_key", "one_per_key", "sent", "spread", "words"]


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text; null gives an empty list."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def clean_id(c: Column) -> Column:
    """The id without surrounding white space, in upper case; null where nothing is left."""
    s = F.upper(F.regexp_replace(c, f"^{SPACES}|{SPACES}$", ""))
    return F.when(s != "", s)


def sent(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """The table, to be broadcast if it has so few rows, else left to the planner. It is counted, so give one that is written."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def one_per_key(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per non-null key; where rows of a key differ, the smallest of their values together counts.

    Keys alone are shuffled to find those that come again, and only the latters' rows follow."""
    x = df.where(F.col(key).isNotNull()).select(key, *cols)
    again = sent(cut(x.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)))
    once = spread(x.join(again, key, "left_anti"), key)
    kept = F.min(F.struct(*[F.col(c) for c in cols])).alias("_kept")
    several = x.join(again, key, "left_semi").groupBy(key).agg(kept).select(key, *[F.col("_kept")[c].alias(c) for c in cols])
    return once.unionByName(several)


def gathered_by_key(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """As one_per_key, but all rows are shuffled by the key, once: the result stays partitioned by it, so that what is
    counted for each key needs no other shuffle."""
    kept = F.min(F.struct(*[F.col(c) for c in cols])).alias("_kept")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(kept).select(key, *[F.col("_kept")[c].alias(c) for c in cols])


def all_pairs(pairs: DataFrame, members: DataFrame, block: int = 1000) -> DataFrame:
    """(id_a, id_b), a < b: every pair of members of linked classes.

    pairs(class_a, class_b): linked classes, each link once, class_a = class_b for links inside a class;
    members(class, id); an id in several classes may come in a pair twice. Classes are cut by hash of the id into blocks of about `block`
    members and links into pairs of blocks, so what is shuffled are lists of ids, and the pairs of a large class are made
    in many tasks."""
    sizes = members.groupBy("class").agg(F.ceil(F.count("*") / block).alias("k"))
    lists = members.join(sizes, "class").groupBy("class", F.pmod(F.xxhash64("id"), F.col("k")).alias("block")).agg(F.collect_list("id").alias("ids"))
    side = lambda d, x: d.select(*[F.col(c).alias(f"{c}_{x}") for c in d.columns])
    blocks = lambda x: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"k_{x}") - 1)).alias(f"block_{x}")
    links = pairs.join(side(sizes, "a"), "class_a").join(side(sizes, "b"), "class_b")
    links = links.select("class_a", "class_b", "k_b", blocks("a")).select("class_a", "class_b", "block_a", blocks("b"))
    links = links.where("class_a != class_b or block_a <= block_b").join(side(lists, "a"), ["class_a", "block_a"]).join(side(lists, "b"), ["class_b", "block_b"])
    # a fixed number of partitions: few bytes of lists become many pairs, so partitions must not be merged by size
    links = links.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "class_a", "block_a", "class_b", "block_b")
    same = (F.col("class_a") == F.col("class_b")) & (F.col("block_a") == F.col("block_b"))
    out = links.select(same.alias("same"), F.explode("ids_a").alias("ia"), "ids_b").select("same", "ia", F.explode("ids_b").alias("ib")).where("not same or ia < ib")
    return out.where("ia != ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
