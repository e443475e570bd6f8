"""Mixtures, hidden Markov models, topics and factorizations, by rounds of distributed sums."""

from __future__ import annotations

import atexit
import glob
import math
import os
import shutil
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions.vector import let

# --- Gaussian mixtures --------------------------------------------------------------------------------------


@dataclass
class GMM:
    """Full covariances; x is an array column. Each round is one pass that adds up sufficient statistics."""

    c: int = 3
    seed: int = 0
    eps: float = 1e-6
    bounds: list[float] = field(default_factory=list)

    def _start(self, df: DataFrame) -> None:
        # the first means lie far apart among a bounded number of rows
        some = df.select("x").orderBy(F.xxhash64(F.lit(self.seed), "x")).limit(50 * self.c).collect()
        rows = np.array([r[0] for r in some], dtype=float)
        x = rows[:1]
        while len(x) < self.c:
            x = np.vstack([x, rows[np.argmax(((rows[:, None] - x[None]) ** 2).sum(-1).min(1))]])
        self.mu, self.sigma, self.pi = x, np.stack([np.eye(x.shape[1])] * self.c), np.full(self.c, 1 / self.c)

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for mu, s in zip(self.mu, self.sigma, strict=True):
            l = np.linalg.cholesky(s + self.eps * np.eye(len(mu)))
            z = np.linalg.solve(l, (x - mu).T)
            out.append(-0.5 * (z**2).sum(0) - np.log(np.diag(l)).sum() - len(mu) / 2 * math.log(2 * math.pi))
        return np.stack(out, axis=1)

    def _statistics(self, df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        def run(batches):
            n = sx = sxx = bound = 0.0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["x"].to_list()).astype(float)
                p = self.log_densities(x) + np.log(self.pi)
                top = p.max(axis=1, keepdims=True)
                total = top + np.log(np.exp(p - top).sum(axis=1, keepdims=True))
                q = np.exp(p - total)
                n, sx, sxx, bound = n + q.sum(0), sx + q.T @ x, sxx + np.einsum("nc,ni,nj->cij", q, x, x), bound + total.sum()
            if np.ndim(n):
                yield pd.DataFrame({"v": [np.concatenate([[bound], np.ravel(n), np.ravel(sx), np.ravel(sxx)]).tolist()]})

        parts = df.select("x").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        v = np.array([r["v"] for r in parts.orderBy("k").collect()])
        c, d = self.mu.shape
        return v[1 : 1 + c], v[1 + c : 1 + c + c * d].reshape(c, d), v[1 + c + c * d :].reshape(c, d, d), float(v[0])

    def fit(self, df: DataFrame, max_iter: int = 10, tol: float = 1e-3) -> GMM:
        self._start(df)
        for _ in range(max_iter):
            n, sx, sxx, bound = self._statistics(df)
            self.pi, self.mu = n / n.sum(), sx / n[:, None]
            self.sigma = sxx / n[:, None, None] - np.einsum("ci,cj->cij", self.mu, self.mu)
            self.bounds.append(bound)
            if len(self.bounds) > 1 and abs(bound - self.bounds[-2]) < tol:
                break
        return self

    def predict_proba(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, component, p): the probability of each component."""

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    log = self.log_densities(np.stack(pdf["x"].to_list()).astype(float)) + np.log(self.pi)
                    p = np.exp(log - log.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), p.shape[1]), "component": np.tile(np.arange(p.shape[1]), len(p)), "p": p.ravel()})

        return df.select(F.col(id_col).alias("id"), "x").mapInPandas(run, "id long, component int, p double")

    def predict(self, df: DataFrame, id_col: str = "id") -> DataFrame:
        """(id, component): the likeliest component, priors counted."""

        def run(batches):
            for pdf in batches:
                x = np.stack(pdf["x"].to_list()).astype(float) if len(pdf) else np.zeros((0, self.mu.shape[1]))
                yield pd.DataFrame({"id": pdf["id"], "component": np.argmax(self.log_densities(x) + np.log(self.pi), axis=1)})

        return df.select(F.col(id_col).alias("id"), "x").mapInPandas(run, "id long, component int")


def m_step(df: DataFrame, component: str, weight: Column, columns: Sequence[str]) -> DataFrame:
    """Weighted means and diagonal variances per component, and its share: one aggregation."""
    exprs = [F.sum(weight).alias("_n")]
    for c in columns:
        exprs += [F.sum(weight * F.col(c)).alias(f"_s_{c}"), F.sum(weight * F.col(c) * F.col(c)).alias(f"_q_{c}")]
    own = df.groupBy(component).agg(*exprs)
    total = own.agg(F.sum("_n").alias("_total"))
    out = own.crossJoin(F.broadcast(total)).withColumn("pi", F.col("_n") / F.col("_total"))
    means = {f"mu_{c}": F.col(f"_s_{c}") / F.col("_n") for c in columns}
    return out.select(component, "pi", *(m.alias(k) for k, m in means.items()), *((F.col(f"_q_{c}") / F.col("_n") - means[f"mu_{c}"] * means[f"mu_{c}"]).alias(f"var_{c}") for c in columns))


# --- hidden Markov models -----------------------------------------------------------------------------------


def _rows(m: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in m))


@dataclass
class MultinomialHMM:
    """a: transitions, b: emissions, pi: start. Sequences are array columns of observation numbers. Zero
    probabilities count as eps."""

    a: np.ndarray
    b: np.ndarray
    pi: np.ndarray
    eps: float = 1e-12

    def _logs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.log(np.maximum(np.asarray(x, dtype=float), self.eps)) for x in (self.a, self.b, self.pi))

    def _scores(self, obs: Column, combine) -> Column:
        """Scores of states after each observation: combine(array over states before) per state."""
        la, lb, lp = self._logs()
        n = len(lp)
        emit = lambda o: F.get(_rows(lb.T), o)
        first = let(emit(F.get(obs, 0)), lambda e: F.array(*(F.get(e, j) + float(lp[j]) for j in range(n))))

        def step(acc: Column, o: Column) -> Column:
            last = F.element_at(acc, -1)
            new = let(emit(o), lambda e: F.array(*(combine(F.array(*(F.get(last, i) + float(la[i, j]) for i in range(n)))) + F.get(e, j) for j in range(n))))
            return F.concat(acc, F.array(new))

        return F.aggregate(F.slice(obs, 2, F.size(obs)), F.array(first), step)

    def log_likelihood(self, obs: Column) -> Column:
        """Forward algorithm in logs; each row is one sequence."""
        lse = lambda v: let(F.array_max(v), lambda top: F.log(F.aggregate(F.transform(v, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)) + top)
        return lse(F.element_at(self._scores(obs, lse), -1))

    def viterbi(self, obs: Column) -> Column:
        """A struct (log_prob, path): the likeliest states; ties go to the smallest state."""
        la, _, _ = self._logs()
        n = len(self.pi)
        arg = lambda v: -F.array_max(F.transform(v, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]

        def back(acc: Column, scores: Column) -> Column:
            nxt = F.element_at(acc, 1)
            return F.concat(F.array(arg(F.zip_with(scores, F.get(_rows(la.T), nxt), lambda s, t: s + t))), acc)

        def trace(scores: Column) -> Column:
            end = F.element_at(scores, -1)
            path = F.aggregate(F.reverse(F.slice(scores, 1, F.size(scores) - 1)), F.array(arg(end)), back)
            return F.struct(F.array_max(end).alias("log_prob"), path.alias("path"))

        assert n
        return let(self._scores(obs, F.array_max), trace)

    def _expectations(self, seqs: DataFrame) -> np.ndarray:
        a, b, pi = (np.maximum(np.asarray(x, dtype=float), self.eps) for x in (self.a, self.b, self.pi))
        n, m = b.shape

        def run(batches):
            total = np.zeros(1 + n + n * n + n * m)
            for pdf in batches:
                for obs in pdf["obs"]:
                    o = np.asarray(obs, dtype=int)
                    if not len(o):
                        continue
                    alpha, scale = np.zeros((len(o), n)), np.zeros(len(o))
                    beta = np.ones((len(o), n))
                    for t in range(len(o)):
                        alpha[t] = (pi if t == 0 else alpha[t - 1] @ a) * b[:, o[t]]
                        scale[t] = alpha[t].sum()
                        alpha[t] /= scale[t]
                    for t in range(len(o) - 2, -1, -1):
                        beta[t] = a @ (b[:, o[t + 1]] * beta[t + 1]) / scale[t + 1]
                    gamma = alpha * beta
                    gamma /= gamma.sum(1, keepdims=True)
                    xi = sum((np.outer(alpha[t], b[:, o[t + 1]] * beta[t + 1]) * a / scale[t + 1] for t in range(len(o) - 1)), np.zeros((n, n)))
                    eb = np.zeros((n, m))
                    np.add.at(eb.T, o, gamma)
                    total += np.concatenate([[np.log(scale).sum()], gamma[0], xi.ravel(), eb.ravel()])
            yield pd.DataFrame({"v": [total.tolist()]})

        parts = seqs.select("obs").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
        return np.array([r["v"] for r in parts.orderBy("k").collect()])

    def fit(self, seqs: DataFrame, max_iter: int = 10, tol: float = 1e-5) -> list[float]:
        """Baum-Welch; returns the log-likelihood before each round."""
        n, m = np.shape(self.b)
        out: list[float] = []
        for _ in range(max_iter):
            v = self._expectations(seqs)
            out.append(float(v[0]))
            self.pi = v[1 : 1 + n] / v[1 : 1 + n].sum()
            xi, eb = v[1 + n : 1 + n + n * n].reshape(n, n), v[1 + n + n * n :].reshape(n, m)
            self.a, self.b = xi / xi.sum(1, keepdims=True), eb / eb.sum(1, keepdims=True)
            if len(out) > 1 and out[-1] - out[-2] <= tol:
                break
        return out

    def generate(self, n_steps: int, seed: int = 0) -> tuple[list[int], list[int]]:
        rng, states, obs = np.random.default_rng(seed), [], []
        for t in range(n_steps):
            p = self.pi if t == 0 else np.asarray(self.a)[states[-1]]
            states.append(int(rng.choice(len(self.pi), p=np.asarray(p) / np.sum(p))))
            e = np.asarray(self.b)[states[-1]]
            obs.append(int(rng.choice(len(e), p=e / e.sum())))
        return states, obs


# --- topics -------------------------------------------------------------------------------------------------


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 6 and the asymptotic series."""
    x, out = np.array(x, dtype=float), np.zeros_like(x, dtype=float)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


#: Words whose sums by topic make a file, tokens that a task takes in, and pairs of document and word that it works on, at once.
SPAN, TOKENS, PAIRS = 1 << 18, 1_000_000, 50_000


@dataclass(frozen=True)
class Topics:
    """Probabilities of words under topics, from sums that workers map (or that travel with the tasks, where the
    shared folder is not mounted). Without either, a draw from the uniform Dirichlet distribution by word and seed."""

    total: tuple[float, ...]
    vocabulary: int
    seed: int = 0
    path: str = ""
    dense: np.ndarray | None = None
    least: float = 0.0

    @staticmethod
    def drawn(words: np.ndarray, t: int, seed: int) -> np.ndarray:
        x = np.arange(t, dtype=np.uint64)[:, None] + words.astype(np.uint64) * np.uint64(t) + np.uint64(seed % 2**32 << 32)
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return -np.log((((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)

    @classmethod
    def start(cls, t: int, vocabulary: int, seed: int) -> Topics:
        spans = (np.arange(at, min(at + SPAN, vocabulary)) for at in range(0, vocabulary, SPAN))
        return cls(tuple(sum((cls.drawn(w, t, seed).sum(1) for w in spans), np.zeros(t))), vocabulary, seed)

    def of(self, words: np.ndarray) -> np.ndarray:
        """Topics x words, for sorted words."""
        total = np.array(self.total)[:, None]
        if self.dense is not None:
            found = self.dense[:, words]
        elif self.path:
            found = np.empty((len(total), len(words)))
            span, at = np.unique(words // SPAN, return_index=True)
            for k, rows in zip(span, np.split(np.arange(len(words)), at[1:]), strict=False):
                found[:, rows] = np.load(f"{self.path}-{k}.npy", mmap_mode="r")[:, words[rows] - k * SPAN]
        else:
            found = self.drawn(words, len(total), self.seed)
        return (found + self.least) / (total + self.least * self.vocabulary)


def _mounted(spark: SparkSession) -> str | None:
    """A new folder beneath the checkpoints, which the driver and all executors share; None where these are not mounted."""
    url = urlparse(spark.sparkContext.getCheckpointDir() or "none:")
    if url.scheme not in ("", "file"):
        return None
    path = os.path.join(url.path, f"quern-lda-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


@dataclass
class LDA:
    """Variational EM on documents (words array<int>), words numbered below `vocabulary`. The sums that a round adds
    up for words stay with the workers, as files of SPAN words in the shared folder; topics tells them. Only where that
    folder is not mounted does the driver gather them, topics x vocabulary numbers."""

    t: int
    vocabulary: int
    seed: int = 0
    alpha: np.ndarray | None = None
    bounds: list[float] = field(default_factory=list)
    topics: Topics | None = None

    def train(self, docs: DataFrame, max_iter: int = 10, tol: float = 5.0, inner: int = 20) -> LDA:
        self.alpha = np.full(self.t, 1.0)
        self.topics, folder = Topics.start(self.t, self.vocabulary, self.seed), _mounted(docs.sparkSession)
        for k in range(max_iter):
            before = self.topics.path
            bound, n_docs, dg = self._e_step(docs, inner, folder and f"{folder}/{k}")
            for old in glob.glob(f"{glob.escape(before)}-*.npy") if before else ():
                os.remove(old)
            self.bounds.append(bound)
            self._newton(dg, n_docs)
            if len(self.bounds) > 1 and abs(self.bounds[-1] - self.bounds[-2]) < tol:
                break
        return self

    def _e_step(self, docs: DataFrame, inner: int, path: str | None) -> tuple[float, float, np.ndarray]:
        """The bound, the number of documents with words, and what alpha's step needs; topics become those of the sums."""
        alpha, topics, t, v = self.alpha[:, None], self.topics, self.t, self.vocabulary
        names = [f"s{k}" for k in range(t)]
        schema = "word long, " + ", ".join(f"{c} double" for c in names)
        rows = lambda words, s: pd.DataFrame(dict(zip(names, s, strict=True))).assign(word=words)[["word", *names]]

        def step(b: np.ndarray, n: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            of = lambda gamma: digamma(gamma) - digamma(gamma.sum(0, keepdims=True))
            gamma = alpha + np.add.reduceat(n, first) / t
            for _ in range(inner):
                phi = b * np.exp(of(gamma))[:, doc] + 1e-100
                phi /= phi.sum(0)
                gamma = alpha + np.add.reduceat(phi * n, first, axis=1)
            e = of(gamma)
            bound = len(first) * (math.lgamma(alpha.sum()) - lgamma(alpha).sum()) + ((alpha - gamma) * e).sum() + (n * (phi * (e[:, doc] + np.log(b + 1e-100) - np.log(phi)))).sum()
            return bound + lgamma(gamma).sum() - lgamma(gamma.sum(0)).sum(), e.sum(1), phi * n

        def run(batches):
            bound, n_docs, dg = 0.0, 0, np.zeros(t)
            for pdf in batches:
                size = pdf["words"].str.len().to_numpy()
                for part in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(np.cumsum(size) // TOKENS)) + 1):
                    flat = np.concatenate([np.zeros(0, np.int64), *pdf["words"].iloc[part]]).astype(np.int64)
                    if not len(flat):
                        continue
                    pair, n = np.unique(np.repeat(np.arange(len(part)), size[part]) * v + flat, return_counts=True)
                    doc, word = np.divmod(pair, v)
                    some, at = np.unique(word, return_inverse=True)
                    b, n, sums = topics.of(some), n.astype(float), np.zeros((t, len(some)))
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    for own in np.split(first, np.flatnonzero(np.diff(first // PAIRS)) + 1):
                        lo, hi = own[0], first[k] if (k := np.searchsorted(first, own[-1]) + 1) < len(first) else len(doc)
                        here = np.repeat(np.arange(len(own)), np.diff(np.append(own, hi)))
                        x, e, phi = step(b[:, at[lo:hi]], n[lo:hi], here, own - lo)
                        bound, n_docs, dg = bound + x, n_docs + len(own), dg + e
                        for s, p in zip(sums, phi, strict=True):
                            s += np.bincount(at[lo:hi], weights=p, minlength=len(some))
                    yield rows(some, sums)
            # of no word: the bound, the documents, and the sums over them
            yield rows([-1, -2, -3], np.stack([np.full(t, bound), np.full(t, float(n_docs)), dg], axis=1))

        def save(pdf: pd.DataFrame) -> pd.DataFrame:
            word, s = pdf["word"].to_numpy(), pdf[names].to_numpy().T
            if word[0] < 0:
                return pdf
            k = word[0] // SPAN
            held = np.zeros((t, min(SPAN, v - k * SPAN)))
            held[:, word - k * SPAN] = s
            with open(tmp := f"{path}-{k}.{uuid.uuid4().hex}.tmp", "wb") as f:
                np.save(f, held)
            os.replace(tmp, f"{path}-{k}.npy")
            return rows([-4], s.sum(1, keepdims=True))

        out = docs.select("words").mapInPandas(run, schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in names))
        if path:
            out = out.groupBy(F.floor(F.col("word") / SPAN)).applyInPandas(save, schema)
        found = out.toPandas()  # a row for each SPAN words
        word, s = found["word"].to_numpy(), found[names].to_numpy().T
        head = {int(w): x for w, x in zip(word, s.T, strict=True) if -4 < w < 0}
        if path:
            dense, total = None, s[:, word == -4].sum(1)
        else:
            dense = np.zeros((t, v))
            dense[:, word[word >= 0]] = s[:, word >= 0]
            total = dense.sum(1)
        self.topics = Topics(tuple(total), v, self.seed, path or "", dense, 1e-9)
        none = np.zeros(t)
        return float(head.get(-1, none)[0]), float(head.get(-2, none)[0]), head.get(-3, none)

    def _newton(self, dg: np.ndarray, n_docs: float, rounds: int = 10) -> None:
        tri = lambda x: (digamma(x + 1e-4) - digamma(x - 1e-4)) / 2e-4
        for _ in range(rounds):
            g = n_docs * (digamma(self.alpha.sum(keepdims=True)) - digamma(self.alpha)) + dg
            h, z = -n_docs * tri(self.alpha), n_docs * tri(self.alpha.sum(keepdims=True))
            c = (g / h).sum() / (1 / z + (1 / h).sum())
            step = (g - c) / h
            new = self.alpha - step
            while (new <= 0).any():
                step = step / 2
                new = self.alpha - step
            self.alpha = new
            if np.abs(step).max() < 1e-4:
                break


def fit_params(counts: DataFrame, n_topics: int, alpha: float, beta: float) -> tuple[DataFrame, DataFrame]:
    """phi (word, topic, p) and theta (doc, topic, p) of counts (doc, word, topic, n), smoothed. Only pairs that
    occur are listed; the others have n = 0."""
    wt = counts.groupBy("word", "topic").agg(F.sum("n").alias("n"))
    t = wt.groupBy("topic").agg(F.sum("n").alias("total"))
    v = counts.agg(F.countDistinct("word").alias("v"))
    phi = wt.join(F.broadcast(t), "topic").crossJoin(F.broadcast(v)).select("word", "topic", ((F.col("n") + beta) / (F.col("total") + F.col("v") * beta)).alias("p"))
    dt = counts.groupBy("doc", "topic").agg(F.sum("n").alias("n"))
    d = dt.groupBy("doc").agg(F.sum("n").alias("total"))
    theta = dt.join(d, "doc").select("doc", "topic", ((F.col("n") + alpha) / (F.col("total") + n_topics * alpha)).alias("p"))
    return phi, theta


def top_words(phi: DataFrame, n: int = 10) -> DataFrame:
    w = W.partitionBy("topic").orderBy(F.desc("p"), "word")
    return phi.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def gibbs(docs: DataFrame, n_topics: int, vocabulary: int, sweeps: int = 5, alpha: float = 0.1, beta: float = 0.01, seed: int = 0) -> DataFrame:
    """Smoothed LDA by collapsed Gibbs sampling, approximately distributed: in a sweep each task samples its
    documents (doc, words) against the topic counts of the sweep before, which are then added up again."""
    spark = docs.sparkSession
    state = docs.select("doc", "words", F.transform("words", lambda w, i: F.pmod(F.xxhash64(F.lit(seed), "doc", i), F.lit(n_topics)).cast("int")).alias("z")).checkpoint()
    for sweep in range(sweeps):
        c = np.zeros((vocabulary, n_topics))
        flat = state.select(F.explode(F.arrays_zip("words", "z")).alias("x")).groupBy("x.words", "x.z").count()
        for r in flat.collect():  # vocabulary x topics at most
            c[r["words"], r["z"]] = r["count"]

        all_topics = c.sum(0)

        def run(batches, c=c, all_topics=all_topics, sweep=sweep):
            for pdf in batches:
                out = []
                for doc, words, z in zip(pdf["doc"], pdf["words"], pdf["z"], strict=True):
                    rng = np.random.default_rng([seed, sweep, int(doc)])
                    at, places = np.unique(np.asarray(words, dtype=int), return_inverse=True)
                    z, own, wt, nt = np.array(z), np.bincount(z, minlength=n_topics).astype(float), c[at], all_topics.copy()
                    for i, w in enumerate(places):
                        k = z[i]
                        own[k] -= 1
                        wt[w, k] -= 1
                        nt[k] -= 1
                        p = np.maximum(wt[w] + beta, 1e-9) / (nt + vocabulary * beta) * (own + alpha)
                        k = int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))
                        z[i] = k
                        own[k] += 1
                        wt[w, k] += 1
                        nt[k] += 1
                    out.append(z.tolist())
                yield pdf[["doc", "words"]].assign(z=out)

        state = state.mapInPandas(run, "doc long, words array<int>, z array<int>").checkpoint()
    return state.select("doc", F.explode(F.arrays_zip("words", "z")).alias("x")).groupBy("doc", F.col("x.words").alias("word"), F.col("x.z").alias("topic")).agg(F.count("*").alias("n")) if spark else state


# --- factorizations -----------------------------------------------------------------------------------------


def half_step(x: DataFrame, own: str, other: str, factor: DataFrame, k: int, alpha: float) -> DataFrame:
    """Ridge solutions for one side of a dense matrix (row, col, v) given the other side's factor (id, f): per
    own key, sums of v f are joined up and solved against the shared k x k matrix of the factor."""
    gram = np.zeros((k, k))
    pairs = factor.select(*(F.sum(F.get("f", i) * F.get("f", j)).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
    for i in range(k):
        for j in range(k):
            gram[i, j] = pairs[f"g{i}_{j}"]
    inv = np.linalg.inv(gram + alpha * np.eye(k))
    sums = x.join(factor.withColumnRenamed("id", other), other).groupBy(F.col(own).alias("id")).agg(*(F.sum(F.col("v") * F.get("f", i)).alias(f"b{i}") for i in range(k)))
    return sums.select("id", F.array(*(sum((F.col(f"b{j}") * float(inv[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k))).alias("f"))


def start_factor(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """Uniform numbers that follow from the ids."""
    return ids.select("id", F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "id"), F.lit(1 << 30)) / float(1 << 30) for i in range(k))).alias("f"))


def loss(x: DataFrame, w: DataFrame, h: DataFrame, alpha: float = 0.0) -> float:
    """Squared error over the entries of x, and the ridge."""
    from quern.functions.vector import dot

    e = x.join(w.select(F.col("id").alias("row"), F.col("f").alias("fw")), "row").join(h.select(F.col("id").alias("col"), F.col("f").alias("fh")), "col")
    out = e.agg(F.sum(F.pow(F.col("v") - dot(F.col("fw"), F.col("fh")), 2))).first()[0] or 0.0
    norms = sum((f.agg(F.sum(F.aggregate("f", F.lit(0.0), lambda s, v: s + v * v))).first()[0] or 0.0) for f in (w, h)) if alpha else 0.0
    return out + alpha * norms


@dataclass
class ALS:
    k: int = 2
    alpha: float = 1.0
    max_iter: int = 5
    tol: float = 1e-4
    seed: int = 0
    losses: list[float] = field(default_factory=list)

    def fit(self, x: DataFrame) -> ALS:
        self.h = start_factor(x.select(F.col("col").alias("id")).distinct(), self.k, self.seed).checkpoint()
        for _ in range(self.max_iter):
            self.w = half_step(x, "row", "col", self.h, self.k, self.alpha).checkpoint()
            self.h = half_step(x, "col", "row", self.w, self.k, self.alpha).checkpoint()
            self.losses.append(loss(x, self.w, self.h, self.alpha))
            if self.losses[-1] <= self.tol:
                break
        return self


@dataclass
class NMF:
    """Coordinate updates that stay nonnegative, one component at a time against the rest."""

    k: int = 2
    max_iter: int = 5
    tol: float = 1e-4
    seed: int = 0
    losses: list[float] = field(default_factory=list)

    def _side(self, x: DataFrame, own: str, other: str, mine: DataFrame, factor: DataFrame) -> DataFrame:
        k = self.k
        row = factor.select(*(F.sum(F.get("f", i) * F.get("f", j)).alias(f"g{i}_{j}") for i in range(k) for j in range(k))).first()
        sums = x.join(factor.withColumnRenamed("id", other), other).groupBy(F.col(own).alias("id")).agg(*(F.sum(F.col("v") * F.get("f", i)).alias(f"b{i}") for i in range(k)))
        out = mine.join(sums, "id").select("id", *(F.get("f", i).alias(f"f{i}") for i in range(k)), *(f"b{i}" for i in range(k)))
        for i in range(k):
            g = max(row[f"g{i}_{i}"], 1e-12)
            rest = sum((F.col(f"f{j}") * float(row[f"g{i}_{j}"]) for j in range(k) if j != i), F.lit(0.0))
            out = out.withColumn(f"f{i}", F.greatest((F.col(f"b{i}") - rest) / g, F.lit(1e-12)))
        return out.select("id", F.array(*(f"f{i}" for i in range(k))).alias("f"))

    def fit(self, x: DataFrame) -> NMF:
        self.h = start_factor(x.select(F.col("col").alias("id")).distinct(), self.k, self.seed).checkpoint()
        self.w = start_factor(x.select(F.col("row").alias("id")).distinct(), self.k, self.seed + 1).checkpoint()
        for _ in range(self.max_iter):
            self.w = self._side(x, "row", "col", self.w, self.h).checkpoint()
            self.h = self._side(x, "col", "row", self.h, self.w).checkpoint()
            self.losses.append(loss(x, self.w, self.h))
            if self.losses[-1] <= self.tol:
                break
        return self
