"""A small listwise ranking network: training on a bounded sample, checkpoints, and vectorised scoring of any table."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.search import FEATURES


@dataclass
class RankingModel:
    """Three linear layers with ReLU between them; one score for each row of features."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]
    state: dict | None = None  # epochs and steps done, and the optimiser's moments: what training goes on from

    @staticmethod
    def random(input_dim: int = 10, hidden_dim: int = 128, seed: int = 0) -> RankingModel:
        rng = np.random.default_rng(seed)
        dims = [(input_dim, hidden_dim), (hidden_dim, hidden_dim), (hidden_dim, 1)]
        bound = lambda i: 1 / i**0.5
        return RankingModel([rng.uniform(-bound(i), bound(i), (i, o)) for i, o in dims], [rng.uniform(-bound(i), bound(i), o) for i, o in dims])

    def forward(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0)
        return x[..., 0]

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON: dimensions, weights, and the optimiser's state where there is one."""
        state = {"input_dim": len(self.weights[0]), "hidden_dim": len(self.biases[0]), "weights": [w.tolist() for w in self.weights], "biases": [b.tolist() for b in self.biases]}
        if self.state:
            state["training"] = {k: [x.tolist() for x in v] if k in ("first", "second") else v for k, v in self.state.items()}
        spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RankingModel:
        s = json.loads(spark.read.parquet(path).first()["state"])
        t = s.get("training")
        return RankingModel([np.array(w) for w in s["weights"]], [np.array(b) for b in s["biases"]], t and {k: [np.array(x) for x in v] if k in ("first", "second") else v for k, v in t.items()})

    def scorer(self, spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
        """A function that adds the column score to a table with the ten features; weights are broadcast once."""
        sent = spark.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(sent.value.forward(np.stack(x.to_numpy()).astype("f8")) if len(x) else [])

        return lambda df: df.withColumn("score", predict(F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES])))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(scores: np.ndarray, twice: bool = True) -> tuple[float, np.ndarray]:
    """Mean listwise loss of lists whose first item is the positive, and its gradient."""
    n = len(scores)
    p = _softmax(scores)
    target = np.zeros_like(p)
    target[:, 0] = 1
    if not twice:
        return float(-np.log(p[:, 0]).mean()), (p - target) / n
    q = _softmax(p)
    g = (q - target) / n
    return float(-np.log(q[:, 0]).mean()), p * (g - (g * p).sum(axis=1, keepdims=True))


def metrics(scores: np.ndarray, k: int = 10) -> tuple[float, float]:
    """Mean reciprocal rank and nDCG at k of lists whose first item is the positive, which wins ties."""
    rank = 1 + (scores[:, 1:] > scores[:, :1]).sum(axis=1)
    return float(np.where(rank <= k, 1 / rank, 0).mean()), float(np.where(rank <= k, 1 / np.log2(rank + 1), 0).mean())


def collect_lists(samples: DataFrame, by: str, size: int, max_lists: int = 200_000) -> np.ndarray:
    """[lists, size, features] of samples(by, label, features) with the positive first; lists of another size are left
    out. At most max_lists come to the driver, those of the smallest digest of their id: the fit is on a bounded sample."""
    g = samples.groupBy(by).agg(F.array_sort(F.collect_list(F.struct((-F.col("label")).alias("l"), "features"))).alias("x")).where((F.size("x") == size) & (F.get(F.col("x"), 0)["l"] == -1))
    rows = g.select(F.col("x.features").alias("f"), F.xxhash64(by).alias("h"), by).orderBy("h", by).limit(max_lists).select("f").collect()
    return np.array([r["f"] for r in rows], float)


def train(train_lists: np.ndarray, val_lists: np.ndarray, hidden_dim: int = 128, epochs: int = 25, batch: int = 64, rate: float = 5e-4, seed: int = 0, twice: bool = True, log: str | None = None, start: RankingModel | None = None) -> tuple[RankingModel, RankingModel, list[dict]]:
    """Adam over shuffled batches. Gives the model of the best mean of MRR and nDCG on val_lists, the last model, and a
    record of each epoch, written as JSON lines to `log` if it is named. From `start`, a last model, training goes on as if
    it had not been broken off."""
    m = RankingModel([w.copy() for w in start.weights], [b.copy() for b in start.biases]) if start else RankingModel.random(train_lists.shape[2], hidden_dim, seed)
    params = [*m.weights, *m.biases]
    done = (start.state if start else None) or {"epoch": 0, "step": 0, "first": [np.zeros_like(p) for p in params], "second": [np.zeros_like(p) for p in params]}
    first, second, step = [x.copy() for x in done["first"]], [x.copy() for x in done["second"]], done["step"]
    best, best_at, history = None, -1.0, []
    for epoch in range(done["epoch"], done["epoch"] + epochs):
        rng = np.random.default_rng([seed, epoch])
        began, losses = time.time(), []
        order = rng.permutation(len(train_lists))
        for at in range(0, len(order), batch):
            x = train_lists[order[at : at + batch]]
            h1 = np.maximum(x @ m.weights[0] + m.biases[0], 0)
            h2 = np.maximum(h1 @ m.weights[1] + m.biases[1], 0)
            loss, g = loss_and_gradient((h2 @ m.weights[2] + m.biases[2])[..., 0], twice)
            losses.append(loss * len(x))
            g3 = g[..., None]
            g2 = (g3 @ m.weights[2].T) * (h2 > 0)
            g1 = (g2 @ m.weights[1].T) * (h1 > 0)
            flat = lambda a: a.reshape(-1, a.shape[-1])
            grads = [flat(x).T @ flat(g1), flat(h1).T @ flat(g2), flat(h2).T @ flat(g3), flat(g1).sum(0), flat(g2).sum(0), flat(g3).sum(0)]
            step += 1
            for i, (p, gr) in enumerate(zip(params, grads)):
                first[i] = 0.9 * first[i] + 0.1 * gr
                second[i] = 0.999 * second[i] + 0.001 * gr**2
                p -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        scores = m.forward(val_lists)
        mrr, ndcg = metrics(scores)
        history.append({"epoch": epoch, "train_loss": sum(losses) / max(1, len(order)), "val_loss": loss_and_gradient(scores, twice)[0], "mrr": mrr, "ndcg": ndcg, "seconds": time.time() - began})
        if (mrr + ndcg) / 2 > best_at:
            best_at, best = (mrr + ndcg) / 2, RankingModel([w.copy() for w in m.weights], [b.copy() for b in m.biases])
    m.state = {"epoch": done["epoch"] + epochs, "step": step, "first": first, "second": second}
    if log:
        Path(log).write_text("".join(json.dumps(h) + "\n" for h in history))
    return best or m, m, history
