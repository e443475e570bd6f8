"""Nearest neighbours, kernel regression and Gaussian processes on tables (id, x, y) with array columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import vector as X

#: A query side of up to so many rows is broadcast; a larger one is dealt in blocks that meet all training rows.
MOST_BROADCAST = 50_000


def pairs(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Every query (q, qx) with every training row. Exact search compares all with all: queries are a stated
    set; they are broadcast only after their rows were counted."""
    few = queries.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return train.crossJoin(F.broadcast(queries) if few else queries)


def nearest(queries: DataFrame, train: DataFrame, k: int, metric: Callable[[Column, Column], Column] = X.euclidean) -> DataFrame:
    """Rows (q, id, y, dist, rank) of the k closest training rows of each query, ties by id. Each task first
    keeps the best k of its own rows, so what meets per query is k rows a task and not the training table."""
    parts = queries.sparkSession.sparkContext.defaultParallelism * 4
    found = pairs(queries, train).select("q", "id", "y", metric(F.col("x"), F.col("qx")).alias("dist"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("_p"))
    own = W.partitionBy("q", "_p").orderBy("dist", "id")
    some = found.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("rank", "_p")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("dist", "id"))).where(F.col("rank") <= k)


@dataclass
class KNN:
    """k nearest neighbours; weights uniform or by 1 / distance. A vote's ties go to the smallest label. With
    distance weights, rows at distance 0 decide alone."""

    k: int = 5
    classifier: bool = True
    metric: Callable[[Column, Column], Column] = X.euclidean
    weights: str = "uniform"
    train: DataFrame | None = None

    def fit(self, train: DataFrame) -> KNN:
        self.train = train
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        near = nearest(queries, self.train, self.k, self.metric)
        if self.weights == "distance":
            near = near.withColumn("_z", F.min("dist").over(W.partitionBy("q")) == 0)
            w = F.when(F.col("_z"), (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("dist")))
        else:
            w = F.lit(1.0)
        near = near.withColumn("w", w)
        if not self.classifier:
            return near.groupBy("q").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
        votes = near.groupBy("q", "y").agg(F.sum("w").alias("w"))
        return votes.groupBy("q").agg(F.max_by("y", F.struct("w", -F.col("y"))).alias("prediction"))


@dataclass
class KernelRegression:
    """Nadaraya-Watson: the kernel-weighted mean of y."""

    kernel: Callable[[Column, Column], Column]
    train: DataFrame | None = None

    def fit(self, train: DataFrame) -> KernelRegression:
        self.train = train
        return self

    def predict(self, queries: DataFrame) -> DataFrame:
        k = pairs(queries, self.train).select("q", "y", self.kernel(F.col("x"), F.col("qx")).alias("k"))
        return k.groupBy("q").agg((F.sum(F.col("k") * F.col("y")) / F.sum("k")).alias("prediction"))


def squared_distances(x: np.ndarray, y: np.ndarray, values: int = 1 << 20) -> np.ndarray:
    """Of each row of x to each of y, by differences, of which about `values` are held at a time."""
    out, step = np.empty((len(x), len(y))), max(1, values // max(1, y.size))
    for at in range(0, len(x), step):
        out[at : at + step] = ((x[at : at + step, None] - y[None]) ** 2).sum(-1)
    return out


def lower_solve(l: np.ndarray, b: np.ndarray, step: int = 128) -> np.ndarray:
    """The solution of l v = b for a lower triangular l, block by block of its rows."""
    v = np.empty(b.shape)
    for at in range(0, len(l), step):
        own = slice(at, at + step)
        v[own] = np.linalg.solve(l[own, own], b[own] - l[own, :at] @ v[:at])
    return v


@dataclass
class GPRegression:
    """A Gaussian process with a kernel plus alpha on the diagonal, on at most `most` training rows, whose
    kernel matrix is factored on the driver; more rows are refused. Queries, any number of them, meet the
    training rows `block` at a time."""

    kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
    alpha: float = 1e-10
    most: int = 2_000
    block: int = 512

    @staticmethod
    def rbf(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.exp(-squared_distances(x, y) / x.shape[1])

    def fit(self, train: DataFrame) -> GPRegression:
        rows = train.select("x", "y").limit(self.most + 1).collect()
        if len(rows) > self.most:
            raise ValueError(f"a Gaussian process takes {self.most} rows at most")
        self.kernel = self.kernel or self.rbf
        self.x, self.y = np.array([r["x"] for r in rows], dtype=float), np.array([r["y"] for r in rows], dtype=float)
        self.l = np.linalg.cholesky(self.kernel(self.x, self.x) + self.alpha * np.eye(len(rows)))
        self.a = np.linalg.solve(self.l.T, np.linalg.solve(self.l, self.y))
        return self

    def covariance(self, queries: DataFrame) -> DataFrame:
        """Rows (a, b, cov) of the posterior's covariance between queries (q, qx), each pair in either order. Queries
        are dealt into blocks of about `block`, and two blocks that meet are one group, so no task sees more."""
        x, l, kernel = self.x, self.l, self.kernel

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            at, ids, own = pdf["at"].to_numpy(), pdf["q"].to_numpy(), np.stack(pdf["qx"].to_list())
            first = at == pdf["lo"].iloc[0]
            second = first if pdf["lo"].iloc[0] == pdf["hi"].iloc[0] else ~first
            v = lower_solve(l, kernel(own, x).T)
            cov = kernel(own[first], own[second]) - v[:, first].T @ v[:, second]
            a, b = (m.ravel() for m in np.broadcast_arrays(ids[first][:, None], ids[second][None]))
            out = pd.DataFrame({"a": a, "b": b, "cov": cov.ravel()})
            return out if second is first else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[["a", "b", "cov"]]])

        n = max(1, -(-queries.count() // self.block))
        dealt = queries.select("q", "qx", F.pmod(F.xxhash64("q"), F.lit(n)).cast("int").alias("at"))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("q", "qx", "at", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"))
        # of two blocks that meet one may have no rows; what is left of them is no pair
        return met.groupBy("lo", "hi").applyInPandas(run, "a long, b long, cov double")

    def evidence(self, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> float:
        """The log marginal likelihood that the training rows would have under another kernel."""
        l = np.linalg.cholesky(kernel(self.x, self.x) + self.alpha * np.eye(len(self.x)))
        a = np.linalg.solve(l.T, np.linalg.solve(l, self.y))
        return float(-0.5 * self.y @ a - np.log(np.diag(l)).sum() - len(self.y) / 2 * math.log(2 * math.pi))

    def predict(self, queries: DataFrame, conf: float = 0.95) -> DataFrame:
        """Rows (q, mean, half_width): the two-sided interval of the given confidence."""
        z = NormalDist().inv_cdf(0.5 + conf / 2)
        x, a, l, kernel, block = self.x, self.a, self.l, self.kernel, self.block

        def run(batches):
            for pdf in batches:
                for at in range(0, len(pdf), block):
                    some = pdf.iloc[at : at + block]
                    k = kernel(np.stack(some["qx"].to_list()), x)
                    var = np.maximum(1 - (lower_solve(l, k.T) ** 2).sum(axis=0), 0)
                    yield some[["q"]].assign(mean=k @ a, half_width=z * np.sqrt(var))

        return queries.select("q", "qx").mapInPandas(run, "q long, mean double, half_width double")

    def marginal_log_likelihood(self) -> float:
        return float(-0.5 * self.y @ self.a - np.log(np.diag(self.l)).sum() - len(self.y) / 2 * math.log(2 * math.pi))

    def sample(self, x: np.ndarray, n: int = 1, posterior: bool = True, seed: int = 0) -> np.ndarray:
        """n draws of function values at x."""
        k = self.kernel(x, x)
        mean = np.zeros(len(x))
        if posterior:
            s = self.kernel(x, self.x)
            v = np.linalg.solve(self.l, s.T)
            mean, k = s @ self.a, k - v.T @ v
        return np.random.default_rng(seed).multivariate_normal(mean, k + 1e-10 * np.eye(len(x)), size=n, method="svd")
