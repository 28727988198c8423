"""One ranking from several differently-scaled scores (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import cut, sent


def _finite(c: Column) -> Column:
    c = c.cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def ideal_point_ranking(
    df: DataFrame,
    scores: dict[str, int],
    query_id: str = "queryid",
    row_id: str = "row_index",
    unit: str | None = "source",
    weights: dict[str, float] | None = None,
    tail: float = 0.05,
    accuracy: int = 10_000,
) -> DataFrame:
    """(query_id, row_id, closeness, place): the records of each query by relative closeness to the ideal point.

    scores maps a column to 1 (larger is better) or -1 (smaller is better). Each score is winsorised at the quantiles
    `tail` and 1 - `tail` of its unit group (reports of one `unit`, null being a unit of its own, share a scale) and
    divided by the root mean square of that group, the vector norm freed from the number of rows. The ideal and the
    anti-ideal point are the best and worst such values of the group. A record's distances to both are Euclidean, each
    score's squared difference counting with its `weights` (1 each); closeness = d- / (d+ + d-). So it is the norm that
    makes scales comparable: a score counts by how far it varies in terms of its own size, once its tails are cut.

    A null, NaN or infinite score is as far from the ideal as from the anti-ideal: half the way between them; so is every
    value of a group that holds but one value, for which that way is 0. A record without any distance has closeness 0.5.
    Records with a null query_id belong to no query and get no row. Equal closeness (rounded to 9 places) goes by row_id;
    repeated rows get places one after another. Other columns are ignored; an empty table gives an empty result.

    One shuffle, that of the queries' records: the statistics are one row a unit, from sketches and sums combined before
    they are sent; they are written, counted, and broadcast if few, so rows don't move by unit."""
    weights = weights or {}
    cols = list(scores)
    u = F.coalesce(F.col(unit).cast("string"), F.lit("\0null")) if unit else F.lit("")
    x = df.select(F.col(query_id).alias("_q"), F.col(row_id).alias("_r"), u.alias("_u"), *[_finite(F.col(c)).alias(f"_s{i}") for i, c in enumerate(cols)])
    cuts = sent(cut(x.groupBy("_u").agg(*[F.percentile_approx(f"_s{i}", [tail, 1 - tail], accuracy).alias(f"_c{i}") for i in range(len(cols))])))
    bounded = lambda i: F.when(F.col(f"_s{i}").isNotNull(), F.least(F.greatest(f"_s{i}", F.col(f"_c{i}")[0]), F.col(f"_c{i}")[1]))
    w = x.join(cuts, "_u").select("_q", "_r", "_u", *[bounded(i).alias(f"_s{i}") for i in range(len(cols))])
    each = lambda i: (F.sqrt(F.avg(F.col(f"_s{i}") * F.col(f"_s{i}"))).alias(f"_n{i}"), F.min(f"_s{i}").alias(f"_lo{i}"), F.max(f"_s{i}").alias(f"_hi{i}"))
    stats = sent(cut(w.groupBy("_u").agg(*[a for i in range(len(cols)) for a in each(i)])))
    plus, minus = F.lit(0.0), F.lit(0.0)
    for i, c in enumerate(cols):
        norm = F.when(F.col(f"_n{i}") > 0, F.col(f"_n{i}"))
        v, lo, hi = (F.col(f"_{p}{i}") / norm for p in ("s", "lo", "hi"))
        best, worst = (hi, lo) if scores[c] > 0 else (lo, hi)
        share, half = F.lit(float(weights.get(c, 1.0))), F.pow((hi - lo) / 2, F.lit(2.0))
        far = lambda point: share * F.coalesce(F.pow(v - point, F.lit(2.0)), half, F.lit(0.0))  # noqa: B023, E731
        plus, minus = plus + far(best), minus + far(worst)
    near = F.coalesce(F.sqrt(minus) / F.nullif(F.sqrt(plus) + F.sqrt(minus), F.lit(0.0)), F.lit(0.5))
    ranked = w.join(stats, "_u").where("_q is not null").select("_q", "_r", F.round(near, 9).alias("closeness"))
    place = F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("closeness"), "_r"))
    return ranked.select(F.col("_q").alias(query_id), F.col("_r").alias(row_id), "closeness", place.alias("place"))
