"""Near-duplicate records with small edits (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import all_pairs, cut, one_per_key, sent, words
from rankloom.llm.components import connected_components

HOT_SHARE = 200_000  # elements that hold more than one in so many of all entries are hot: fewer than that many


def shingles(text: Column, size: int) -> tuple[Column, Column]:
    """The hashes (64 bits) of the words, and from them (as _w) those of the distinct runs of `size` consecutive words,
    in order of hash; null where there are fewer words."""
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(0), F.size("_w") - size), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(size)]))
    return hashed, F.when(F.size("_w") >= size, F.sort_array(F.array_distinct(runs)))


class ShingleSets:
    """Records as sets of shingles. `members(class, id)` groups the records of equal sets; `sets(class, n, set)` has each
    distinct set once. A class is the number of one of its records."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, size: int) -> None:
        w, runs = shingles(F.col("_t"), size)
        each = one_per_key(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_t")), "id", "_t")
        s = each.select("id", w.alias("_w")).select("id", runs.alias("set")).where("set is not null")
        # a set is known by 128 bits
        s = cut(s.select(F.monotonically_increasing_id().alias("r"), "id", F.xxhash64("set").alias("k"), F.xxhash64(F.lit(1), "set").alias("l"), F.size("set").alias("n"), "set"))
        several = s.groupBy("k", "l").agg(F.min("r").alias("class"), F.count("*").alias("c")).where("c > 1").select("k", "l", "class")
        self.members = cut(s.select("r", "id", "k", "l").join(several, ["k", "l"], "left").select(F.coalesce("class", "r").alias("class"), "id", "r"))
        others = self.members.where("r != class").select("r")
        self.members = self.members.select("class", "id")
        self.sets = s.join(others, "r", "left_anti").select(F.col("r").alias("class"), "n", "set")


def _prefixes(sets: DataFrame, threshold: float, extra: int) -> DataFrame:
    """(class, n, lead, pre): the first elements of each set in one order for all, rarest first, that other sets have too:
    array<struct<f, e>>. lead elements of the set, found in no other, stand before them. pre holds as many as are needed
    for two sets of the threshold to have `extra` elements of it in common, or all that the sets have.

    Occurrences are counted with map-side combining. What is then shuffled by element leaves out those in one set alone,
    by the join, and the hot ones (see HOT_SHARE), which are broadcast: no task gets a hot element. Hot elements stand
    last in the order; they are put in only for the sets whose other elements are too few."""
    postings = sets.select("class", "n", F.explode("set").alias("e"))
    counts = cut(postings.groupBy("e").agg(F.count("*").alias("f")).where("f > 1"))
    total = counts.agg(F.sum("f")).first()[0] or 0
    limit = max(32, total // HOT_SHARE)
    hot = F.broadcast(counts.where(F.col("f") > limit))  # fewer than HOT_SHARE rows
    rare = postings.select("class", "e").join(hot.select("e"), "e", "left_anti").join(counts.where(F.col("f") <= limit), "e")
    rare = rare.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("rare"))
    n_hot = postings.select("class", "e").join(hot.select("e"), "e", "left_semi").groupBy("class").agg(F.count("*").alias("n_hot"))
    most = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + extra
    s = sets.select("class", "n").join(rare, "class", "left").join(n_hot, "class", "left")
    s = s.select("class", "n", F.coalesce("rare", F.array().cast("array<struct<f:bigint,e:bigint>>")).alias("rare"), F.coalesce("n_hot", F.lit(0)).cast("int").alias("n_hot"))
    s = s.withColumn("lead", F.col("n") - F.size("rare") - F.col("n_hot")).withColumn("room", most - F.col("lead")).where("room > 0")
    s = cut(s.select("class", "n", "lead", "room", F.slice("rare", F.lit(1), F.col("room")).alias("pre"), ((F.col("room") > F.size("rare")) & (F.col("n_hot") > 0)).alias("short")))
    short = sets.join(s.where("short").select("class"), "class", "left_semi").select("class", F.explode("set").alias("e"))
    more = short.join(hot, "e").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("hot"))
    both = s.join(more, "class", "left").select("class", "n", "lead", F.when(F.col("hot").isNotNull(), F.slice(F.concat("pre", "hot"), F.lit(1), F.col("room"))).otherwise(F.col("pre")).alias("pre"))
    return both.where(F.size("pre") > 0)


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, similarity), a < b: all pairs of distinct sets whose Jaccard similarity reaches the threshold.

    sets(class, n, set). Two sets that similar share at least ceil(threshold * n) elements of each; with one order for
    all, rarest first, they share k elements among the first n - ceil(threshold n) + k of both. Elements that no other set
    has fill those places first and are skipped.

    Size-aware join: a set whose prefix is small is light: all 2-subsets of its prefix (k = 2) are enumerated, and light
    sets that share one meet. Other sets are heavy: they scan the inverted lists of the prefixes (k = 3), which hold light
    and heavy sets, and meet the sets found three times. The size that divides them is the one of least total cost: subsets
    enumerated and the pairs expected to meet in them, against list entries scanned. Before they are counted, meetings of
    sets too different in size, or too late in both sets to leave room for the common elements needed, are dropped.
    Candidates are verified by exact intersection."""
    t = F.lit(threshold)
    p = cut(_prefixes(sets, threshold, 3))
    # the light prefix (k = 2) is shorter by one element, where the set has that many
    need = F.col("n") - F.ceil(F.col("n") * t - 1e-9).cast("int") - F.col("lead")
    p = p.withColumn("p2", F.greatest(F.lit(0), F.least(F.size("pre"), need + 2)))
    entries = F.aggregate("pre", F.lit(0).cast("bigint"), lambda acc, x: acc + x["f"])
    # a subset meets at most as many sets as its rarer element is in
    subsets = F.aggregate(F.transform(F.slice("pre", F.lit(1), F.col("p2")), lambda x, i: x["f"] * (F.col("p2") - 1 - i)), F.lit(0).cast("bigint"), lambda acc, x: acc + x) / 4
    table = p.groupBy("p2").agg(F.sum(F.col("p2") * (F.col("p2") - 1.0) / 2 + subsets).alias("a"), F.sum(entries).alias("b")).orderBy("p2").collect()  # a row a prefix size
    costs = [(sum(r["a"] for r in table[:i]) + sum(r["b"] for r in table[i:]), i) for i in range(len(table) + 1)]
    at = min(costs)[1] if costs else 0
    boundary = table[at - 1]["p2"] if at else 0  # prefixes up to it are light
    # elements needed in common, and where they may still come from
    alike = (F.col("na") >= t * F.col("nb") - 1e-9) & (F.col("nb") >= t * F.col("na") - 1e-9)
    needed = t / (1 + t) * (F.col("na") + F.col("nb")) - 1e-9
    left = lambda d, *cols: d.select(F.col("class").alias("class_a"), F.col("n").alias("na"), *cols)
    right = lambda d, *cols: d.select(F.col("class").alias("class_b"), F.col("n").alias("nb"), *cols)

    light = p.where((F.col("p2") <= boundary) & (F.col("p2") > 1)).select("class", "n", F.slice(F.col("pre.e"), F.lit(1), F.col("p2")).alias("x"))
    pos = F.sequence(F.lit(0), F.size("x") - 1)
    pairs = F.flatten(F.transform(pos, lambda i: F.transform(F.slice("x", i + 2, F.size("x")), lambda y: F.xxhash64(F.get(F.col("x"), i), y))))
    sig = light.select("class", "n", F.explode(pairs).alias("sig"))
    met = left(sig, "sig").join(right(sig, "sig"), "sig").where((F.col("class_a") < F.col("class_b")) & alike).select("class_a", "class_b")

    lists = p.select("class", "n", (F.col("p2") <= boundary).alias("light"), "lead", F.posexplode(F.col("pre.e")).alias("i", "e")).withColumn("rest", F.col("n") - F.col("lead") - F.col("i") - 1).drop("lead", "i")
    met3 = left(lists.where("not light"), "e", F.col("rest").alias("ra")).join(right(lists, "e", F.col("rest").alias("rb"), F.col("light").alias("lb")), "e")
    met3 = met3.where((F.col("class_a") != F.col("class_b")) & (F.col("lb") | (F.col("class_a") < F.col("class_b"))) & alike & (F.least("ra", "rb") + 3 >= needed))
    # a pair of one or two elements in common can only be alike where so few are needed
    few = F.least(F.lit(3), F.ceil(F.min(needed)))
    scanned = met3.groupBy("class_a", "class_b").agg(F.count("*").alias("c"), few.alias("few")).where("c >= few").select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    # sets of which one element is all that is needed in common have no 2-subset
    single = lists.where((F.col("n") * t <= 1 + 1e-9) & F.col("light"))
    one = left(single, "e").join(right(lists.where("light"), "e"), "e").where((F.col("class_a") != F.col("class_b")) & alike & (needed <= 1)).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    cand = cut(met.unionByName(scanned).unionByName(one).distinct())
    asked = sent(cand.select(F.explode(F.array("class_a", "class_b")).alias("class")).distinct())
    need_sets = sets.join(asked, "class", "left_semi")
    a = need_sets.select(F.col("class").alias("class_a"), F.col("n").alias("na"), F.col("set").alias("sa"))
    b = need_sets.select(F.col("class").alias("class_b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return cand.join(a, "class_a").join(b, "class_b").select("class_a", "class_b", "na", "nb", common.alias("common")).withColumn("similarity", similarity).where(F.col("similarity") >= threshold - 1e-12).select("class_a", "class_b", "similarity")


def _linked(df: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> tuple[ShingleSets, DataFrame]:
    s = ShingleSets(df, id_col, text_col, size)
    return s, cut(similar_sets(s.sets, threshold))


def near_duplicate_pairs(df: DataFrame, id_col: str = "docid", text_col: str = "body", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id_a, id_b), a < b: records whose sets of distinct runs of `size` consecutive words have a Jaccard similarity of
    at least `threshold`, equal sets among them.

    A record is a distinct non-null id (of differing rows the smallest text counts). Null, empty and shorter texts have
    no runs and no partner. Texts are read whole. Other columns are ignored; an empty table gives an empty result. Every
    pair is written, however many records have equal sets, so the result grows with the square of such a group; for a
    result that grows with the records see near_duplicate_groups and class_links."""
    s, links = _linked(df, id_col, text_col, size, threshold)
    inside = s.members.groupBy("class").count().where("count > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    return all_pairs(links.select("class_a", "class_b").unionByName(inside), s.members)


def class_links(df: DataFrame, id_col: str = "docid", text_col: str = "body", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(class_a, class_b, size_a, size_b, similarity): the links between the classes of equal sets, each class named by its
    first record, and the classes of several records with themselves: the pairs before they are written out. Membership
    is the class_id of near_duplicate_groups."""
    s, links = _linked(df, id_col, text_col, size, threshold)
    first = s.members.groupBy("class").agg(F.min("id").alias("id"), F.count("*").alias("size"))
    side = lambda x: first.select(F.col("class").alias(f"class_{x}"), F.col("id").alias(f"id_{x}"), F.col("size").alias(f"size_{x}"))
    x = links.join(side("a"), "class_a").join(side("b"), "class_b")
    turn = F.col("id_a") > F.col("id_b")
    pick = lambda c, d: F.when(turn, F.col(d)).otherwise(F.col(c))
    between = x.select(F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"), pick("size_a", "size_b").alias("size_a"), pick("size_b", "size_a").alias("size_b"), "similarity")
    inside = first.where("size > 1").select(F.col("id").alias("class_a"), F.col("id").alias("class_b"), F.col("size").alias("size_a"), F.col("size").alias("size_b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(inside)


def near_duplicate_groups(df: DataFrame, id_col: str = "docid", text_col: str = "body", size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, class_id, group_id, links): for each record with at least one run of words, the first record of its copies,
    the first record of its group of near-duplicates, and how many other distinct texts it is linked to."""
    s, links = _linked(df, id_col, text_col, size, threshold)
    comp = connected_components(links, "class_a", "class_b").select(F.col("node").alias("class"), "component")
    degree = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    first = s.members.groupBy("class").agg(F.min("id").alias("class_id"))
    full = first.join(comp, "class", "left").join(degree, "class", "left").select("class", "class_id", F.coalesce("component", "class").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    group = full.groupBy("component").agg(F.min("class_id").alias("group_id"))
    return s.members.join(full.join(group, "component"), "class").select("id", "class_id", "group_id", "links")
