"""Bandits: estimates by replay of a log (policy-free), and simulations dealt over tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expected_values(arms: DataFrame, arm: str = "arm", payoff: str = "payoff", prob: str = "prob") -> DataFrame:
    return arms.groupBy(arm).agg(F.sum(F.col(payoff) * F.col(prob)).alias("ev"))


def running(log: DataFrame, arm: str, reward: str, order: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Adds n and mean of each arm's rewards so far, within a group (a policy's run) and along an order."""
    w = W.partitionBy(*group, arm).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("n", F.count("*").over(w)).withColumn("mean", F.avg(reward).over(w))


def ucb1(mean: Column, n: Column, t: Column, c: float = 1.0) -> Column:
    return mean + c * F.sqrt(F.log(t.cast("double")) / n)


def beta_posterior(log: DataFrame, arm: str, success: Column, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """(arm, alpha, beta, map): the posterior of a success rate; its mode, or where it has none its mean."""
    own = log.groupBy(arm).agg((F.sum(success.cast("double")) + alpha).alias("alpha"), (F.sum(1.0 - success.cast("double")) + beta).alias("beta"))
    a, b = F.col("alpha"), F.col("beta")
    mode = F.when((a > 1) & (b > 1), (a - 1) / (a + b - 2)).when((a <= 1) & (b > 1), 0.0).when((a > 1) & (b <= 1), 1.0).otherwise(a / (a + b))
    return own.withColumn("map", mode)


def linucb_statistics(log: DataFrame, arm: str, x: Sequence[Column], reward: Column) -> DataFrame:
    """Per arm, I + sum x x' (upper half, a_i_j) and sum r x (b_i)."""
    a = [(F.sum(x[i] * x[j]) + float(i == j)).alias(f"a_{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return log.groupBy(arm).agg(*a, *(F.sum(reward * c).alias(f"b_{i}") for i, c in enumerate(x)))


def linucb_scores(stats: pd.DataFrame, x: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Upper confidence bounds of arms (rows of collected statistics, one per arm) at a context."""
    d, out = len(x), []
    for _, r in stats.iterrows():
        a = np.array([[r[f"a_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        inv = np.linalg.inv(a)
        out.append(inv @ np.array([r[f"b_{i}"] for i in range(d)]) @ x + alpha * np.sqrt(x @ inv @ x))
    return np.array(out)


def smoothed(values: Column, weight: float) -> Column:
    """Exponential smoothing w previous + (1 - w) current of an ordered array; the first value stands."""

    def step(acc: Column, v: Column) -> Column:
        new = F.when(F.size(acc) == 0, v).otherwise(weight * F.element_at(acc, -1) + (1 - weight) * v)
        return F.concat(acc, F.array(new))

    return F.aggregate(values, F.array().cast("array<double>"), step)


# --- simulations ------------------------------------------------------------------------------------------


@dataclass
class Bandit:
    """kind: multinomial (payoffs, probs per arm), bernoulli (probs), gaussian (means, variances, probs),
    linear (theta: dimensions x arms, noise variance), contextual (probs: contexts x arms)."""

    kind: str
    payoffs: list | None = None
    probs: list | None = None
    theta: np.ndarray | None = None
    variance: float = 1.0

    @property
    def n_arms(self) -> int:
        return np.shape(self.theta)[1] if self.kind == "linear" else np.shape(self.probs)[1] if self.kind == "contextual" else len(self.probs)

    def context(self, rng: np.random.Generator) -> np.ndarray | None:
        if self.kind == "linear":
            return rng.normal(size=np.shape(self.theta)[0])
        return np.eye(np.shape(self.probs)[0])[rng.integers(np.shape(self.probs)[0])] if self.kind == "contextual" else None

    def evs(self, x: np.ndarray | None) -> np.ndarray:
        match self.kind:
            case "multinomial":
                return np.array([np.dot(v, p) for v, p in zip(self.payoffs, self.probs, strict=True)])
            case "gaussian":
                return np.array([m * p for (m, _), p in zip(self.payoffs, self.probs, strict=True)])
            case "linear":
                return x @ np.asarray(self.theta)
            case "contextual":
                return x @ np.asarray(self.probs)
        return np.array(self.probs, dtype=float)

    def pull(self, arm: int, x: np.ndarray | None, rng: np.random.Generator) -> float:
        match self.kind:
            case "multinomial":
                return float(rng.choice(self.payoffs[arm], p=self.probs[arm]))
            case "gaussian":
                m, v = self.payoffs[arm]
                return float(rng.normal(m, np.sqrt(v)) * (rng.random() < self.probs[arm]))
            case "linear":
                return float(self.evs(x)[arm] + rng.normal(0, np.sqrt(self.variance)))
        return float(rng.random() < self.evs(x)[arm])


def path_arms(paths: DataFrame, most: int = 10_000) -> Bandit:
    """A bandit whose arms are paths (path, w) that pay minus their weight. Arms live in a simulation's memory, so
    more than `most` are refused."""
    w = [float(r["w"]) for r in paths.orderBy("w", "path").limit(most + 1).collect()]
    if len(w) > most:
        raise ValueError(f"more than {most} paths")
    return Bandit("multinomial", [[-v] for v in w], [[1.0]] * len(w))


@dataclass
class Policy:
    """kind: epsilon_greedy (value = epsilon), ucb1 (C), thompson (prior alpha = beta), linucb (alpha)."""

    kind: str
    value: float = 0.1
    prior: float = 0.5

    def start(self, n: int, d: int) -> dict:
        return {"n": np.zeros(n), "ev": np.full(n, self.prior), "a": np.full(n, self.value or 1.0), "b": np.full(n, self.value or 1.0), "A": np.stack([np.eye(d)] * n), "r": np.zeros((n, d)), "t": 0}

    def choose(self, s: dict, x: np.ndarray | None, rng: np.random.Generator) -> int:
        match self.kind:
            case "epsilon_greedy":
                return int(rng.integers(len(s["n"]))) if rng.random() < self.value else int(np.argmax(s["ev"]))
            case "ucb1":
                return int(np.argmax(s["ev"] + self.value * np.sqrt(np.log(s["t"] + 1) / (s["n"] + 1e-7))))
            case "thompson":
                return int(np.argmax(rng.beta(s["a"], s["b"])))
        inv = np.linalg.inv(s["A"])
        return int(np.argmax([inv[k] @ s["r"][k] @ x + self.value * np.sqrt(x @ inv[k] @ x) for k in range(len(inv))]))

    def learn(self, s: dict, arm: int, reward: float, x: np.ndarray | None) -> None:
        s["t"] += 1
        s["n"][arm] += 1
        s["ev"][arm] = reward if s["n"][arm] == 1 else s["ev"][arm] + (reward - s["ev"][arm]) / s["n"][arm]
        s["a"][arm] += reward
        s["b"][arm] += 1 - reward
        if x is not None:
            s["A"][arm] += np.outer(x, x)
            s["r"][arm] += reward * x


@dataclass
class BanditTrainer:
    """Runs policies against a bandit; each (policy, duplicate) is one group of one task."""

    policies: dict[str, Policy] = field(default_factory=dict)

    def compare(self, spark: SparkSession, bandit: Bandit, n_trials: int, n_duplicates: int, seed: int = 0) -> DataFrame:
        """The log (policy, dup, trial, arm, reward, oracle, mse)."""
        policies = self.policies

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            name, dup = pdf["policy"].iloc[0], int(pdf["dup"].iloc[0])
            rng, p = np.random.default_rng([seed, dup, sorted(policies).index(name)]), policies[name]
            x = bandit.context(rng)
            s, rows = p.start(bandit.n_arms, 1 if x is None else len(x)), []
            for t in range(n_trials):
                x = bandit.context(rng)
                ev = bandit.evs(x)
                arm = p.choose(s, x, rng)
                reward = bandit.pull(arm, x, rng)
                p.learn(s, arm, reward, x)
                rows.append((name, dup, t, arm, reward, ev.max(), float(np.mean((s["ev"] - ev) ** 2)) if x is None else None))
            return pd.DataFrame(rows, columns=["policy", "dup", "trial", "arm", "reward", "oracle", "mse"])

        runs = spark.createDataFrame([(p, d) for p in policies for d in range(n_duplicates)], "policy string, dup int")
        return runs.groupBy("policy", "dup").applyInPandas(run, "policy string, dup int, trial int, arm int, reward double, oracle double, mse double")


def regret(log: DataFrame) -> DataFrame:
    """Adds regret and cumulative regret along each run."""
    w = W.partitionBy("policy", "dup").orderBy("trial").rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("regret", F.col("oracle") - F.col("reward")).withColumn("cumulative", F.sum(F.col("oracle") - F.col("reward")).over(w))
