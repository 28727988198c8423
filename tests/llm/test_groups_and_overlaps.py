import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.llm import overlap, splits
from rankloom.llm.common import all_pairs, clean_id, one_per_key, words
from rankloom.llm.components import connected_components

SCHEMA = "row_index bigint, docid string, queryid bigint, query string, split string, source string, rel int"


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = random.Random(4)
    edges = {"random": [(rng.randrange(120), rng.randrange(120)) for _ in range(90)], "chain": [(i, i + 1) for i in range(64)], "star": [(0, i) for i in range(1, 50)] + [(7, 7)]}[kind]
    got = connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(want)


def test_components_of_nothing(spark):
    e = spark.createDataFrame([(None, 1), (2, 2)], "a int, b int")
    assert connected_components(e, "a", "b").count() == 0


def test_clean_id(spark):
    df = spark.createDataFrame([(" d1\t",), ("",), ("  ",), (None,), (" D2　",), ("d 3",)], "d string")
    assert [r[0] for r in df.select(clean_id(F.col("d"))).collect()] == ["D1", None, None, None, "D2", "D 3"]


def test_words(spark):
    df = spark.createDataFrame([("Ab_c-1², É",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(words(F.col("t"))).collect()] == [["ab", "c", "1²", "é"], [], []]


RECORDS = [
    (0, "D2", 1, "a", "train", "x", 1),
    (1, " d2 ", 2, "b", "val", "x", 0),
    (2, "D1", 2, "c", None, None, None),
    (3, None, 1, "d", "test", "y", 1),
    (4, "  ", None, "e", "train", "y", 1),
    (5, "D9", 9, None, "train", "y", 1),
    (6, None, 5, "f", "train", "y", 1),
    (7, None, 5, "g", "train", "y", 1),
    (0, "D2", 1, "a", "train", "x", 1),
]


def test_found_groups(spark, rows):
    df = spark.createDataFrame(RECORDS, SCHEMA).withColumn("group_key", F.lit("clash"))
    assert rows(splits.found_groups(df)) == [(0, "D1"), (1, "D1"), (2, "D1"), (3, "D1"), (6, None), (7, None)]
    assert splits.found_groups(df.limit(0)).count() == 0


def test_grouped_split(spark):
    rng = random.Random(5)
    recs = [(i, f"D{rng.randrange(700)}" if rng.random() < 0.9 else None, rng.randrange(2000) if rng.random() < 0.95 else None, "q", None, rng.choice(["a", "b", None]), rng.choice([0, 1, 2, 3, None])) for i in range(1000)]
    recs += [(1000 + i, "HOT", 100_000 + i, "q", None, "a", 1) for i in range(500)]
    df = spark.createDataFrame(recs, SCHEMA)
    plan = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, share double")
    got = {r[0]: r[1] for r in splits.grouped_split(df, plan, cell_groups=60).collect()}
    assert len(got) == 1500
    of = {}
    for r in recs:
        for k in ([("q", r[2])] if r[2] is not None else []) + ([("d", r[1])] if r[1] else []):
            assert of.setdefault(k, got[r[0]]) == got[r[0]]
    share = Counter(got.values())
    assert abs(share["train"] / 1500 - 0.8) < 0.03 and min(share["val"], share["test"]) > 100
    assert splits.grouped_split(df.limit(0), plan).count() == 0


def test_a_rare_label_is_not_lost_in_a_hash(spark):
    names = spark.range(300).select(F.concat(F.lit("s"), "id").alias("s"))
    meet = names.groupBy(F.pmod(F.xxhash64("s"), F.lit(64))).agg(F.sort_array(F.collect_list("s")).alias("s")).where(F.size("s") > 1).first()["s"]
    rare, common = meet[:2]  # two values of one bucket
    recs = [(i, None, 10_000 + i, "q", None, rare if i < 50 else common, None) for i in range(1000)]
    df = spark.createDataFrame(recs, SCHEMA)
    plan = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, share double")
    for limit, exact in ((64, True), (2, True), (1, False)):
        got = {r[0]: r[1] for r in splits.grouped_split(df, plan, max_values=limit).collect()}
        assert Counter(got.values()) == {"train": 800, "val": 100, "test": 100}
        assert (Counter(got[i] for i in range(50)) == {"train": 40, "val": 5, "test": 5}) == exact


def test_stratify_prefers_the_rare():
    counts = np.array([[2, 0, 2], [2, 1, 1], [2, 0, 2], [2, 1, 1]])
    need = np.array([0.5, 0.5])[:, None] * counts.sum(axis=0)[None, :]
    s = splits.stratify(counts, need)
    assert s[1] != s[3] and s[0] != s[2]


# --- overlaps ----------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    d = distance(a, b)
    return bool(a and b) and (a == b or sorted(a.split()) == sorted(b.split()) or (d <= 3 and 5 * d <= max(len(a), len(b))))


TEXT = st.text("ab c", min_size=1, max_size=24).map(lambda s: " ".join(s.split())).filter(bool)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.tuples(st.integers(0, 2), st.integers(0, 23), st.sampled_from("abc ")), max_size=3))
def test_the_bounds_lose_nothing(a, changes):
    b = a
    for kind, at, ch in changes:
        at %= len(b) or 1
        b = b[:at] + ("" if kind == 0 else ch) + b[at + (kind != 1) :]
    b = " ".join(b.split())
    if not near(a, b):
        return
    known, weight = WEIGHTS
    v = overlap.vectors([a, b], known, weight)
    ta, tb = (set(t.tolist()) for t in v.terms)
    k = overlap.edits(max(len(a), len(b)))
    dot = sum(t >> overlap.WEIGHT_BITS for t in ta & tb)
    assert [len(ta), len(tb)] == [len(a) + 1, len(b) + 1] and [sum(t >> overlap.WEIGHT_BITS for t in s) for s in (ta, tb)] == v.w.tolist()
    assert all(dot >= w - lost[k] for w, lost in zip(v.w, v.lost))
    assert abs(len(a) - len(b)) <= overlap.MAX_EDITS and len(b) in overlap.partner_lengths(len(a))
    both = set(v.prefix[0].tolist()) & set(v.prefix[1].tolist())
    bound = lambda t: (t >> overlap.WEIGHT_BITS) + min(v.rest[i][v.prefix[i].tolist().index(t)] for i in (0, 1))
    assert both and any(bound(t) >= dot for t in both)
    for m in ("m1", "m2"):
        assert bin((int(v[m][0]) ^ int(v[m][1])) & (2**64 - 1)).count("1") <= 4 * k


#: idf of the pairs of the letters above: very unequal, one pair unknown
_CODES = sorted((ord(p) << 21) | ord(q) for p in "abc " for q in "abc " if p + q != "cb")
WEIGHTS = (np.array(_CODES), np.array([1 + 61 * (i * 7 % 15) for i in range(len(_CODES))]))


def test_terms_of_a_vector_weigh_unequally():
    v = overlap.vectors(["abab cb", "x"], *WEIGHTS)
    w = [t >> overlap.WEIGHT_BITS for t in v.terms[0].tolist()]
    assert w == sorted(w, reverse=True) and len(set(w)) > 3 and len(v.terms[1]) == 2
    assert v.prefix[0].tolist() == v.terms[0].tolist()[: 2 * overlap.edits(8) + 1]


def test_overlaps_against_brute_force(spark):
    rng = random.Random(6)
    base = ["how to treat mild pain", "cost of a red car", "why is the sky blue", "ab", "x"]
    recs = []
    for i in range(160):
        q = rng.choice(base)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(q) + 1)
            q = q[:at] + rng.choice(["", "z", " "]) + q[at + rng.randrange(2) :]
        if rng.random() < 0.2:
            w = q.split()
            rng.shuffle(w)
            q = " ".join(w)
        recs.append((i, rng.choice(["D1", "d1 ", "D2", None]), rng.choice([*range(40), None]), rng.choice([q, q.upper() + "!", None, ""]) if rng.random() < 0.3 else q, rng.choice(["train", "train", "val", "test", None]), rng.choice(["s", None]), 1))
    import regex

    norm = lambda q: " ".join(regex.findall(r"[\p{L}\p{N}]+", (q or "").lower()))
    want = set()
    for x, y in itertools.permutations(recs, 2):
        same = x[1] and y[1] and x[1].strip().upper() == y[1].strip().upper()
        if x[4] == "train" and y[4] in ("val", "test") and same and ((x[2] is not None and x[2] == y[2]) or near(norm(x[3]), norm(y[3]))):
            want.add((x[0], y[0]))
    df = spark.createDataFrame([*recs, recs[0]], SCHEMA).withColumn("text", F.lit(1))
    got = overlap.overlaps(df).collect()
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(want)
    counts = overlap.overlap_counts(df).collect()
    assert sum(r["pairs"] for r in counts) == len(want)
    classes = overlap.overlap_classes(df).collect()
    by = lambda kind: sum(r["train_records"] * r["held_records"] for r in classes if r["kind"] == kind)
    assert max(by("id"), by("text") + by("near")) <= len(want) <= by("id") + by("text") + by("near") and len({(r[0], r[1], r[2], r[3]) for r in classes}) == len(classes)
    assert overlap.overlap_classes(df.limit(0)).count() == 0
    assert overlap.overlaps(df.limit(0)).count() == 0


def test_all_pairs(spark, rows):
    members = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 10), ("b", 11)], "class string, id int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a")], "class_a string, class_b string")
    assert len(rows(all_pairs(pairs, members))) == 8 + 6


def test_one_per_key(spark, rows):
    df = spark.createDataFrame([("a", "x", "2"), ("a", "x", "1"), ("b", None, None), ("b", None, None), ("c", "y", None), (None, "z", "z")], "k string, t string, u string")
    assert rows(one_per_key(df, "k", "t", "u")) == [("a", "x", "1"), ("b", None, None), ("c", "y", None)]
    assert one_per_key(df.limit(0), "k", "t").count() == 0
