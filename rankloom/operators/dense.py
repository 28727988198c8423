"""Dense retrieval: embedding, clustering, exact and cluster-pruned cosine search, and fusion with lexical evidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from rankloom.functions import scoring as S
from rankloom.session import cut

PROBES = 5
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """Texts to unit vectors by signed hashing of their words; stands in where no model is at hand."""
    import zlib

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), "f4")
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 0x80000000 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    return run


def embed(docs: DataFrame, encoder: Encoder, dim: int, batch: int = 32, prefix: str = "", id_col: str = "doc_id", max_docs: int | None = None) -> DataFrame:
    """(doc_id, embedding): the encoder over title + body in batches; raises where it gives another dimension."""
    docs = docs if max_docs is None else docs.limit(max_docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = (prefix + pdf.t).tolist()
            parts = [encoder(texts[i : i + batch]) for i in range(0, len(texts), batch)]
            if parts and parts[0].shape[1] != dim:
                raise ValueError(f"the encoder gives {parts[0].shape[1]} dimensions, not {dim}")
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": [x for p in parts for x in p.astype("f4")]})

    text = F.concat(F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    return docs.select(id_col, text.alias("t")).mapInPandas(run, f"{id_col} {kind}, embedding array<float>")


def truncate_embeddings(df: DataFrame, dims: int, vec_col: str = "embedding") -> DataFrame:
    """Layer norm, the first dims components, unit length."""
    return df.withColumn(vec_col, S.truncated(F.col(vec_col), dims))


def fit_clusters(vectors: DataFrame, k: int = 1024, seed: int = 42, max_iter: int = 100, vec_col: str = "embedding") -> DataFrame:
    """(cluster, centroid) by k-means over all vectors."""
    m = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v").fit(vectors.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("_v")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(m.clusterCenters())]
    return vectors.sparkSession.createDataFrame(rows, "cluster int, centroid array<double>")


def mean_centroids(vectors: DataFrame, cluster: str = "label", vec_col: str = "embedding") -> DataFrame:
    """(cluster, centroid): the mean vector of given clusters."""
    x = vectors.select(F.col(cluster).alias("cluster"), F.posexplode(vec_col).alias("i", "x"))
    m = x.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("cluster", F.col("s.x").alias("centroid"))


def _centres(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.orderBy("cluster").collect()  # one row a cluster
    return np.array([r["cluster"] for r in rows]), np.array([r["centroid"] for r in rows], float)


def assign_clusters(vectors: DataFrame, centroids: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """vectors with the column cluster: the nearest centroid. No shuffle."""
    ids, c = _centres(centroids)
    both = vectors.sparkSession.sparkContext.broadcast((ids, c.astype("f4"), (c**2).sum(axis=1)))

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        ids, c, sq = both.value
        m = np.stack(v.to_numpy()).astype("f4")
        return pd.Series(ids[np.argmin(sq[None, :] - 2 * (m @ c.T), axis=1)])

    return vectors.withColumn("cluster", nearest(vec_col))


def _closest(queries: np.ndarray, centres: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and Euclidean distances of each query's nearest centres; ties go to the first."""
    d = np.sqrt(np.maximum(0, (queries**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * queries @ centres.T))
    near = np.argsort(np.round(d, 9), axis=1, kind="stable")[:, :probes]
    return near, np.take_along_axis(d, near, axis=1)


def closest_clusters(spark: SparkSession, queries: list[tuple[int, list[float]]], centroids: DataFrame, probes: int = PROBES) -> DataFrame:
    """(qid, cluster, distance, place): each query's nearest centroids by Euclidean distance. A batch of queries and the
    centroids are both bounded, so the driver does it by one matrix product."""
    ids, c = _centres(centroids)
    near, d = _closest(np.array([x[1] for x in queries], float), c, probes)
    rows = [(q, int(ids[j]), float(x), place) for (q, _), js, xs in zip(queries, near, d) for place, (j, x) in enumerate(zip(js, xs), 1)]
    return spark.createDataFrame(rows, "qid bigint, cluster int, distance double, place int")


def exact_top(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 100, id_col: str = "doc_id", vec_col: str = "embedding", block: int = 512) -> DataFrame:
    """(qid, id, similarity, rank): exact cosine search of a batch of queries against all vectors.

    The batch is broadcast and scored in blocks, a matrix product for each batch of vectors; a task keeps each query's best
    k of what it has seen, so what is shuffled is at most k rows a query and task."""
    return _scan(vectors.select(F.col(id_col).alias("id"), F.lit(None).cast("int").alias("cluster"), F.col(vec_col).cast("array<float>").alias("v")), queries, None, k, id_col, block)


def pruned_top(vectors: DataFrame, centroids: DataFrame, queries: list[tuple[int, list[float]]], k: int = 100, probes: int = PROBES, id_col: str = "doc_id", vec_col: str = "embedding", block: int = 512) -> DataFrame:
    """As exact_top, over the vectors of each query's nearest clusters alone. vectors has the column cluster; where the
    table is partitioned by it, the clusters no query asks for are not read."""
    ids, c = _centres(centroids)
    near = ids[_closest(np.array([x[1] for x in queries], float), c, probes)[0]]
    v = vectors.where(F.col("cluster").isin(sorted({int(x) for x in near.ravel()})))
    return _scan(v.select(F.col(id_col).alias("id"), F.col("cluster").cast("int").alias("cluster"), F.col(vec_col).cast("array<float>").alias("v")), queries, near, k, id_col, block)


def _scan(v: DataFrame, queries: list[tuple[int, list[float]]], near: np.ndarray | None, k: int, id_col: str, block: int) -> DataFrame:
    q = np.array([x[1] for x in queries], "f8")
    n = np.linalg.norm(q, axis=1, keepdims=True)
    sent = v.sparkSession.sparkContext.broadcast(([x[0] for x in queries], q / np.where(n > 0, n, 1), near))
    kind = v.schema["id"].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, u, near = sent.value
        best = [np.empty(0, "int64"), np.empty(0, object), np.empty(0)]
        least = np.full(len(u), -np.inf)
        for pdf in it:
            if not len(pdf):
                continue
            m = np.stack(pdf.v.to_numpy()).astype("f8")
            length = np.linalg.norm(m, axis=1)
            m = m / np.where(length > 0, length, 1)[:, None]
            ids, cl = pdf.id.to_numpy(), pdf.cluster.to_numpy()
            found = [best]
            for at in range(0, len(u), block):
                s = np.round(u[at : at + block] @ m.T, 9)
                if near is not None:
                    s[~(near[at : at + block, :, None] == cl[None, None, :]).any(axis=1)] = -np.inf
                floor = least[at : at + block]
                if s.shape[1] > k:  # what ties with the k-th stays, ids decide
                    floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
                a, b = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
                found.append([a + at, ids[b], s[a, b]])
            q, i, s = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((i, -s, q))
            q, i, s = q[order], i[order], s[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            full = nth == k - 1
            least[q[full]] = s[full]
            best = [x[nth < k] for x in (q, i, s)]
        if len(best[0]):
            yield pd.DataFrame({"qid": np.array(qids)[best[0]], "id": best[1], "similarity": best[2]})

    part = v.mapInPandas(run, f"qid bigint, id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), "id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def fuse(df: DataFrame, cosine: str = "similarity", score: str | None = "prediction") -> DataFrame:
    """df(qid, ...) with the column fused: min-max cosine of the query's rows plus exp of min-max score, less one.

    Without a score the second part is 0. A query has a bounded number of candidates."""
    w = Window.partitionBy("qid")
    scaled = lambda c: S.min_max(F.col(c), F.min(c).over(w), F.max(c).over(w))
    return df.withColumn("fused", S.fused(scaled(cosine), scaled(score)) if score else scaled(cosine))


class DenseSearch:
    """Semantic mode of the engine: cosine candidates, lexical features where they have any, re-ranked and fused."""

    def __init__(self, vectors: DataFrame, encoder: Encoder, centroids: DataFrame | None = None, candidates: int = 100, probes: int = PROBES, approximate: bool = True) -> None:
        self.vectors, self.encoder, self.centroids = vectors, encoder, centroids
        self.candidates, self.probes, self.approximate = candidates, probes, approximate and centroids is not None

    def search(self, engine: object, batch: list[tuple[int, str]], num_return: int, rerank: bool = True) -> DataFrame:
        """(qid, rank, score, doc_id, num_results); num_results counts the vectors compared."""
        from rankloom.plans.query_language import SearchMode

        coded = [(q, [float(x) for x in v]) for (q, _), v in zip(batch, self.encoder([t or "" for _, t in batch]))]
        top = pruned_top(self.vectors, self.centroids, coded, self.candidates, self.probes) if self.approximate else exact_top(self.vectors, coded, self.candidates)
        c = engine.compile(batch, SearchMode.OR, spelling=False, idf_threshold=None)
        top = cut(top.drop("rank"))
        lexical = attach_features(top, engine.lexical(c, top), engine.index.doc_stats, engine.stats)
        if engine.ranker and rerank:
            scored = fuse(engine.ranker(lexical).withColumnRenamed("score", "prediction"))
        else:
            scored = fuse(lexical, score=None)
        top = engine.top(scored, "fused", num_return).withColumn("score", F.col("fused"))
        if self.approximate:
            sizes = {r["cluster"]: r["count"] for r in self.vectors.groupBy("cluster").count().collect()}
            ids, cen = _centres(self.centroids)
            near, _ = _closest(np.array([x[1] for x in coded], float), cen, self.probes)
            compared = [(q, sum(sizes.get(int(i), 0) for i in ids[row])) for (q, _), row in zip(coded, near)]
        else:
            n = self.vectors.count()
            compared = [(q, n) for q, _ in coded]
        totals = engine.index.docs.sparkSession.createDataFrame(compared, "qid bigint, num_results bigint")
        return top.join(F.broadcast(totals), "qid").select("qid", "rank", "score", "doc_id", "num_results")


def attach_features(hits: DataFrame, lexical: DataFrame, doc_stats: DataFrame, stats: dict[str, float]) -> DataFrame:
    """hits(qid, doc_id, ...) with the ten features; a hit that holds no word of its query has zero scores and first
    occurrences of 1.0."""
    from rankloom.operators.search import FEATURES

    j = hits.join(lexical, ["qid", "doc_id"], "left").join(doc_stats, "doc_id", "left")
    share = lambda f: F.coalesce(F.col(f"{f}_len"), F.lit(0)) / F.lit(float(stats[f"max_{f}"] or 1))
    fill = {FEATURES[i]: F.coalesce(FEATURES[i], F.lit(v)) for i, v in enumerate((0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0))}
    fill |= {FEATURES[7]: share("body"), FEATURES[8]: share("title"), FEATURES[9]: F.coalesce(FEATURES[9], F.lit(0))}
    return j.select(*hits.columns, *[fill[f].alias(f) for f in FEATURES])
