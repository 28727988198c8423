import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import nearduplicates as nd
from rankloom.llm import neighbours as nb
from rankloom.llm.common import all_pairs


def brute(ids, m, k):
    u = m.astype("f8") / np.linalg.norm(m.astype("f8"), axis=1)[:, None]
    out = {}
    for i, q in enumerate(ids):
        s = np.round(np.einsum("j,ij->i", u[i], u), 6)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = {ids[j] for j in order}
    return out


def table(spark, ids, m):
    return spark.createDataFrame(list(zip(ids.tolist(), m.astype("f4").tolist())), "vec_id bigint, embedding array<float>")


def clustered(n, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(12, dim))
    return (c[rng.integers(12, size=n)] + rng.normal(size=(n, dim)) * 0.3).astype("f4") * rng.uniform(0.1, 9, (n, 1)).astype("f4")


def test_recall_on_clusters(spark):
    m = clustered(1500)
    ids = np.random.default_rng(1).permutation(9000)[:1500]
    got = nb.nearest(table(spark, ids, m), cell_rows=64).toPandas()
    want = brute(ids, m, 10)
    mine = got.groupby("vec_id").neighbour.apply(set)
    assert len(got) == 15_000 and np.mean([len(want[i] & mine[i]) / 10 for i in ids]) > 0.98


def test_recall_without_clusters(spark):
    m = np.random.default_rng(2).normal(size=(800, 64)).astype("f4")
    ids = np.arange(800)
    mine = nb.nearest(table(spark, ids, m), cell_rows=64).toPandas().groupby("vec_id").neighbour.apply(set)
    want = brute(ids, m, 10)
    assert np.mean([len(want[i] & mine[i]) / 10 for i in ids]) >= 0.9


def test_many_equal_vectors_tie_by_id(spark):
    m = np.repeat(np.random.default_rng(3).normal(size=(1, 64)), 3000, axis=0)
    got = nb.nearest(table(spark, np.arange(3000), m), k=3).toPandas()
    mine = got.groupby("vec_id").neighbour.apply(sorted)
    assert mine[0] == [1, 2, 3] and mine[1] == [0, 2, 3] and mine[2999] == [0, 1, 2] and len(got) == 9000


def test_unusable_vectors(spark):
    ok = [1.0] * 64
    rows = [(1, ok), (1, ok), (2, [2.0] * 63 + [1.0]), (3, None), (4, []), (5, [0.0] * 64), (6, [float("nan")] * 64), (7, [1.0] * 63), (None, ok), (8, [None] * 64), (9, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash"))
    assert sorted((r[0], r[1]) for r in nb.nearest(df).collect()) == [(1, 2), (2, 1)]
    assert [tuple(r) for r in nb.neighbour_pairs(df).collect()] == [(1, 2)]
    assert nb.nearest(df.limit(0)).count() == 0


def test_windows_are_the_counts_of_near_projections():
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(150, 8)).astype("f4"), rng.normal(size=(7, 8)).astype("f4")
    d = nb.axes(8, 12)
    half = np.linspace(0.1, 1.5, 7)
    p, at = q @ d, v @ d
    rank = np.argsort(np.argsort(at, axis=0), axis=0)
    lo = (at[None] < p[:, None] - half[:, None, None]).sum(axis=1) // nb.STEP * nb.STEP
    hi = -(-(at[None] <= p[:, None] + half[:, None, None]).sum(axis=1) // nb.STEP) * nb.STEP
    count = ((rank[None] >= lo[:, None]) & (rank[None] < hi[:, None])).sum(axis=2)
    a = nb.Arrays(v, d)
    for least in (1, 5, 9, 12):
        got = np.concatenate([h for _, h in a.collisions(p, half, least, block=3)])
        assert (got == (count >= least)).all()


def test_axes_stand_at_right_angles():
    d = nb.axes(16, 24).astype("f8")
    assert np.allclose(d[:, :16].T @ d[:, :16], np.eye(16), atol=1e-6) and np.allclose((d**2).sum(axis=0), 1, atol=1e-6)


def test_verified_share_falls(spark):
    """Clusters of fixed size: the larger the table, the smaller the share of pairs that are verified."""
    share = []
    for groups in (10, 60):
        rng = np.random.default_rng(8)
        m = (rng.normal(size=(groups, 1, 64)) + rng.normal(size=(groups, 40, 64)) * 0.2).reshape(-1, 64)
        n, tally = len(m), spark.sparkContext.accumulator(0)
        mine = nb.nearest(table(spark, np.arange(n), m), cell_rows=40, tally=tally).toPandas().groupby("vec_id").neighbour.apply(set)
        want = brute(np.arange(n), m.astype("f4"), 10)
        assert np.mean([len(want[i] & mine[i]) / 10 for i in range(n)]) > 0.97
        share.append(tally.value / n**2)
    assert share[1] < share[0] / 2


@pytest.fixture
def narrow(spark):
    """Sets how many bytes of results the driver takes from the tasks of a stage."""
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    yield lambda size: conf.set("spark.driver.maxResultSize", size)
    conf.set("spark.driver.maxResultSize", before)


def recall(got, ids, m):
    want, mine = brute(ids, m, 10), got.groupby("vec_id").neighbour.apply(set)
    return np.mean([len(want[i] & mine[i]) / 10 for i in ids])


def test_driver_takes_one_sample_and_not_one_of_each_task(spark, narrow):
    m, ids = clustered(3000, seed=5), np.arange(3000)
    df = table(spark, ids, m).repartition(24)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task for each file
    narrow("512k")
    try:
        got = nb.nearest(df, sample_rows=400)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    narrow("1g")
    assert recall(got.toPandas(), ids, m) > 0.97


def test_driver_takes_bits_of_rings_that_reach_each_other(spark, narrow):
    """Without clusters every ring reaches every other, so lists of them grow with the square of their number."""
    m, ids = np.random.default_rng(6).normal(size=(3000, 64)).astype("f4"), np.arange(3000)
    narrow("1m")
    got = nb.nearest(table(spark, ids, m), cell_rows=4)
    narrow("1g")
    assert recall(got.toPandas(), ids, m) >= 0.9


@pytest.mark.parametrize("want", [1, 30, 299, 300, 1000])
def test_sample_is_of_the_least_hashes(spark, want):
    df = spark.range(300).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("v")).repartition(7)
    first = [r["id"] for r in df.orderBy(F.xxhash64("id"), "id").limit(want).collect()]
    assert nb.sample(df, 300, want).tolist() == [[i, 1] for i in first]


def test_groups_stand_by_what_they_reach():
    rng = np.random.default_rng(7)
    for n in (1, 9, 70):
        reach = (rng.random((n, n)) < 0.08) | np.eye(n, dtype=bool)
        sizes, together = rng.integers(1, 50, n), 60
        count, order, want, group, held = reach.sum(axis=1), [], {}, 0, 0
        for start in sorted(range(n), key=lambda c: (-sizes[c], c)):
            queue = [start]
            for c in queue:
                if c not in order:
                    order.append(c)
                    queue += sorted((x for x in range(n) if reach[c, x] and x not in order and count[x] <= 2 * count[c]), key=lambda x: (count[x], x))
        for c in order:
            if held and held + sizes[c] > together:
                group, held = group + 1, 0
            want[c], held = group, held + sizes[c]
        assert nb._groups(np.packbits(reach, axis=1, bitorder="little"), sizes, together).tolist() == [want[c] for c in range(n)]


def test_rings_reached_are_those_of_the_triangle_inequality():
    rng = np.random.default_rng(8)
    unit = lambda x: (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4")
    q, c = unit(rng.normal(size=(40, 6))), unit(rng.normal(size=(25, 6)))
    rings = np.array(sorted(rng.choice([i * 8 + b for i in range(25) for b in range(5)], 80, replace=False)))
    radius = rng.uniform(0, 0.4, 40)
    edges, d = [0, *nb.BANDS, 2.0], np.sqrt(np.maximum(0, 2 - 2 * q @ c.T))
    want = [any(d[i, r // 8] - radius[i] <= edges[r % 8 + 1] + 1e-5 and d[i, r // 8] + radius[i] >= edges[r % 8] - 1e-5 for i in range(40)) for r in rings]
    assert nb.reaches(q, radius, c, rings).tolist() == want and not all(want)


# --- near-duplicates ---------------------------------------------------------------------------------------------------


def texts(seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for i in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 6, 12, 40, 120]))]
        out.append(w)
        for _ in range(rng.randrange(3)):
            v = list(w)
            for _ in range(rng.randrange(1 + len(v) // 15)):
                at = rng.randrange(len(v))
                v[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
            out.append(v)
    return [(f"D{i:03d}", " ".join(w)) for i, w in enumerate(out)]


def shingle_sets(recs, size):
    return {i: {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for i, t in recs for w in [t.split()] if len(w) >= size}


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.7), (5, 0.8), (1, 0.5)])
def test_pairs_against_brute_force(spark, rows, size, threshold):
    recs = texts()
    s = shingle_sets(recs, size)
    want = sorted((a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9)
    df = spark.createDataFrame([*recs, recs[0], (None, recs[0][1]), ("E1", None), ("E2", ""), ("E3", "two words"[:size])], "docid string, body string").withColumn("n", F.lit(1)).withColumn("class", F.lit(2))
    assert rows(nd.near_duplicate_pairs(df, size=size, threshold=threshold)) == want and want
    groups = nd.near_duplicate_groups(df, size=size, threshold=threshold).collect()
    of = {r["id"]: r["group_id"] for r in groups}
    assert all(of[a] == of[b] for a, b in want) and set(of) >= set(s)


def test_copies_are_classes(spark, rows):
    df = spark.createDataFrame([(f"D{i:03d}", "a b c d e f") for i in range(50)] + [("X", "a b c d e f g")], "docid string, body string")
    assert nd.near_duplicate_pairs(df, size=3, threshold=0.7).count() == 51 * 50 // 2
    g = nd.near_duplicate_groups(df, size=3, threshold=0.7)
    assert {(r["class_id"], r["group_id"], r["links"]) for r in g.collect()} == {("D000", "D000", 1), ("X", "D000", 1)}
    assert rows(nd.class_links(df, size=3, threshold=0.7)) == [("D000", "D000", 50, 50, 1.0), ("D000", "X", 50, 1, 0.8)]
    assert nd.near_duplicate_pairs(df.limit(0)).count() == nd.class_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [50_000, 40])
def test_hot_elements_lose_nothing(spark, rows, monkeypatch, share):
    """Boilerplate in all texts, some of which hold hardly anything else."""
    monkeypatch.setattr(nd, "HOT_SHARE", share)
    rng = random.Random(9)
    plate = " ".join(f"p{i}" for i in range(30))
    recs = [(f"D{i:03d}", f"{plate} " + " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 5, 14])))) for i in range(120)]
    s = shingle_sets(recs, 3)
    want = sorted((a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9)
    assert rows(nd.near_duplicate_pairs(spark.createDataFrame(recs, "docid string, body string"), size=3, threshold=0.8)) == want and want


def test_large_classes_are_written_in_full(spark, rows):
    marks = [" ", ", ", " - ", "; "]
    body = lambda i, w: "".join(x + marks[i // 4**k % 4] for k, x in enumerate(w.split()))
    one = [(f"D{i:03d}", body(i, "a b c d e f")) for i in range(101)]  # different bodies of one set
    near = [(f"E{i:03d}", body(i, "a b c d e f g")) for i in range(100)]
    assert len({b for _, b in one + near}) == 201
    df = spark.createDataFrame(one + near, "docid string, body string")
    want = list(itertools.combinations([i for i, _ in one + near], 2))
    assert rows(nd.near_duplicate_pairs(df, size=3, threshold=0.7)) == want
    assert rows(nd.near_duplicate_pairs(df.where("docid < 'E'"), size=3, threshold=0.7)) == [x for x in want if x[1] < "E"]


def test_blocks_lose_and_repeat_nothing(spark, rows):
    n = 57
    members = spark.createDataFrame([("ab"[i % 2], i) for i in range(n)] + [("c", n)], "class string, id int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("b", "c")], "class_a string, class_b string")
    want = {(i, j) for i, j in itertools.combinations(range(n + 1), 2) if (j < n and (i % 2 == 0 or j % 2 == 0)) or (j == n and i % 2)}
    for block in (1, 5, 1000):
        got = [tuple(r) for r in all_pairs(pairs, members, block).collect()]
        assert len(got) == len(want) and set(got) == want
