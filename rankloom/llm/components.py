"""Connected components of a large graph, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rankloom.llm.common import cut, discard


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges come as u > v."""
    m = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(m, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, with their number and checksum, which are taken while it is written."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("x")
    out = cut(e.observe(seen, *sums))
    return out, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node of it.

    The number of rounds grows with the logarithm of the longest path. Each round aggregates a node's least neighbour
    with map-side combining, joins it back (a hub's rows are split by adaptive skew joins), and writes its links;
    links and components never come to the driver, only a count and a checksum. Null ends and self-links add nothing;
    an empty input gives an empty result."""
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    e, before = _written(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if not before[0]:
            break
        last, (e, now) = e, _written(_small_star(_large_star(e)))
        discard(last)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
