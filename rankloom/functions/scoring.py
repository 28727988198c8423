"""BM25 over two fields, fusion of scores, and ranking metrics, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The parameters of the scoring formulas.
K1 = 1.6
B = 0.75
TITLE_WEIGHT = 2.0
IDF_THRESHOLD = 1.5


def idf(n: Column, df: Column) -> Column:
    """May be negative for terms in more than half of the documents."""
    return F.ln((n - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, length: Column, average: Column, b: float = B) -> Column:
    """Length-normalised term frequency; 0 where the average length is 0."""
    return F.when(average > 0, tf / (1 - b + b * (length / average))).otherwise(F.lit(0.0))


def bm25_part(idf_: Column, weight: Column, k: float = K1) -> Column:
    return idf_ * (weight * (k + 1)) / (weight + k)


def classic_bm25(idf_: Column, tf: Column, length: Column, average: Column, k: float = K1, b: float = B) -> Column:
    """One field, one term."""
    return idf_ * tf * (k + 1) / (tf + k * (1 - b + b * length / average))


def min_max(x: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    return (x - low) / (high - low + eps)


def fused(cosine_norm: Column, score_norm: Column) -> Column:
    return cosine_norm + (F.exp(score_norm) - 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, however often `then` uses it below other lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def scaled(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    part = lambda n: lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))
    return _let(a, lambda v: _let(norm(v), lambda n: F.transform(v, part(n))))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Zero mean and unit population variance."""
    mean = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(arr)
    centred = lambda m: F.transform(a, lambda x: x.cast("double") - m)
    return _let(_let(mean(a), centred), lambda c: _let(F.sqrt(dot(c, c) / F.size(c) + eps), lambda d: F.transform(c, lambda x: x / d)))


def truncated(a: Column, dims: int) -> Column:
    """Layer norm, the first dims components, unit length."""
    return scaled(F.slice(layer_norm(a), 1, dims))


def mrr(rank: Column, k: int = 10) -> Column:
    """Of the one relevant item's rank."""
    return F.when(rank <= k, 1.0 / rank).otherwise(F.lit(0.0))


def ndcg(rank: Column, k: int = 10) -> Column:
    """Of the one relevant item's rank; the ideal gain is 1."""
    return F.when(rank <= k, 1.0 / F.log2(rank + 1.0)).otherwise(F.lit(0.0))


def mlp_forward(features: list[Column], layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """A small network written out as one expression (ReLU between layers). For large ones use operators.ranker."""
    x = features
    for i, (w, b) in enumerate(layers):
        x = [reduce(lambda s, t: s + t, (v * F.lit(float(c)) for v, c in zip(x, row)), F.lit(float(bias))) for row, bias in zip(w, b)]
        if i + 1 < len(layers):
            x = [F.greatest(v, F.lit(0.0)) for v in x]
    return x[0]
