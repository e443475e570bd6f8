"""Reinforcement learning over transition tables (episode, t, s, a, r, s2), and tabular agents in small worlds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class EnvModel:
    """Counts (s, a, r, s2, n) of what followed each state and action."""

    counts: DataFrame

    @classmethod
    def fit(cls, transitions: DataFrame) -> EnvModel:
        return cls(transitions.where("s2 is not null").groupBy("s", "a", "r", "s2").agg(F.count("*").alias("n")))

    def state_action_pairs(self) -> DataFrame:
        return self.counts.select("s", "a").distinct()

    def reward_outcome_pairs(self, s, a) -> DataFrame:
        return self.counts.where((F.col("s") == s) & (F.col("a") == a)).select("r", "s2")

    def outcome_probs(self) -> DataFrame:
        total = self.counts.groupBy("s", "a").agg(F.sum("n").alias("total"))
        return self.counts.join(total, ["s", "a"]).select("s", "a", "r", "s2", (F.col("n") / F.col("total")).alias("p"))

    def pairs_leading_to(self, s2) -> DataFrame:
        return self.counts.where(F.col("s2") == s2).select("s", "a").distinct()

    def sweep(self, q: DataFrame, gamma: float = 0.9) -> DataFrame:
        """One sweep of expected updates: (s, a, q, priority) from (s, a, q)."""
        best = q.groupBy(F.col("s").alias("s2")).agg(F.max("q").alias("best"))
        new = self.outcome_probs().join(best, "s2", "left").groupBy("s", "a").agg(F.sum(F.col("p") * (F.col("r") + gamma * F.coalesce("best", F.lit(0.0)))).alias("new"))
        return new.join(q, ["s", "a"], "left").select("s", "a", F.col("new").alias("q"), F.abs(F.col("new") - F.coalesce("q", F.lit(0.0))).alias("priority"))

    def value_iteration(self, gamma: float = 0.9, rounds: int = 5) -> DataFrame:
        q = self.state_action_pairs().withColumn("q", F.lit(0.0))
        for _ in range(rounds):
            q = self.sweep(q, gamma).select("s", "a", "q").checkpoint()
        return q


def returns(transitions: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Adds g, the discounted rewards from t to the end of the episode."""
    w = W.partitionBy("episode").orderBy("t")
    scale = F.pow(F.lit(float(gamma)), F.col("t").cast("double"))
    rest = F.sum(F.col("r") * scale).over(w.rowsBetween(0, W.unboundedFollowing))
    return transitions.withColumn("g", rest / scale)


def first_visit_values(transitions: DataFrame, gamma: float = 1.0) -> DataFrame:
    """On-policy Monte Carlo: mean return of the first visits (s, a, q, n)."""
    first = F.row_number().over(W.partitionBy("episode", "s", "a").orderBy("t"))
    visits = returns(transitions, gamma).withColumn("_k", first).where("_k = 1")
    return visits.groupBy("s", "a").agg(F.avg("g").alias("q"), F.count("*").alias("n"))


def td_step(q: Column, r: Column, best: Column, lr: float = 0.4, gamma: float = 0.99) -> Column:
    """The update towards r + gamma * best, best being 0 (null) at the end."""
    return q + lr * (r + gamma * F.coalesce(best, F.lit(0.0)) - q)


def q_learning_episodes(transitions: DataFrame, lr: float = 0.4, gamma: float = 0.9) -> DataFrame:
    """State values by one ordered pass over each episode by itself: (episode, s, v). The state is a map from
    state to value that a fold carries along the episode."""
    steps = transitions.groupBy("episode").agg(F.sort_array(F.collect_list(F.struct("t", "s", "r", "s2"))).alias("e"))
    zero = F.create_map().cast("map<string,double>")

    def step(m: Column, x: Column) -> Column:
        key, old = x["s"].cast("string"), F.coalesce(F.element_at(m, x["s"].cast("string")), F.lit(0.0))
        after = F.coalesce(F.element_at(m, x["s2"].cast("string")), F.lit(0.0))
        new = old + lr * (x["r"] + gamma * after - old)
        return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, new))

    return steps.select("episode", F.explode(F.aggregate("e", zero, step)).alias("s", "v"))


def elite(samples: DataFrame, theta: Sequence[str], reward: str, keep: int, key: str) -> DataFrame:
    """The cross-entropy method's refit: mean and variance of the `keep` best samples' parameters."""
    best = samples.orderBy(F.desc(reward), key).limit(keep)
    return best.agg(*(f(c).alias(f"{k}_{c}") for c in theta for k, f in (("mean", F.avg), ("var", F.var_pop))))


def tiles(x: Sequence[Column], n: int, wrap: Sequence[int | None] | None = None) -> Column:
    """Tile coordinates of n tilings: per tiling its number and, per dimension, (floor(n x) + offset) / n,
    wrapped where a width is given."""
    wrap = wrap or [None] * len(x)

    def coordinate(c: Column, k: int, tiling: Column, width: int | None) -> Column:
        q = F.floor((F.floor(c * n) + tiling * (2 * k + 1) % n) / n)
        return q if width is None else F.pmod(q, F.lit(width))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda t: F.array(t.cast("bigint"), *(coordinate(c, k, t, w) for k, (c, w) in enumerate(zip(x, wrap, strict=True)))))


def hashed_tile(coordinates: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(coordinates), F.lit(size))


# --- agents in a grid world -------------------------------------------------------------------------------


@dataclass
class GridWorld:
    """size x size cells, start at 0, goal in the last; -1 a step. Actions: right, left, down, up."""

    size: int = 4

    @property
    def n_states(self) -> int:
        return self.size * self.size

    def step(self, s: int, a: int) -> tuple[int, float, bool]:
        r, c = divmod(s, self.size)
        dr, dc = ((0, 1), (0, -1), (1, 0), (-1, 0))[a]
        r, c = min(max(r + dr, 0), self.size - 1), min(max(c + dc, 0), self.size - 1)
        s2 = r * self.size + c
        return s2, -1.0, s2 == self.n_states - 1


@dataclass
class Agent:
    """kind: monte_carlo (on- or off-policy), td (expected Sarsa or Q-learning), dyna, cross_entropy."""

    kind: str = "td"
    off_policy: bool = False
    lr: float = 0.4
    epsilon: float = 0.1
    gamma: float = 0.95
    simulated: int = 20
    samples: int = 30
    keep: float = 0.2

    def _act(self, q: np.ndarray, s: int, rng: np.random.Generator) -> int:
        return int(rng.integers(4)) if rng.random() < self.epsilon else int(rng.choice(np.flatnonzero(q[s] == q[s].max())))

    def _episode(self, env: GridWorld, act, most: int) -> list[tuple[int, int, float, int, bool]]:
        s, out = 0, []
        for _ in range(most):
            a = act(s)
            s2, r, done = env.step(s, a)
            out.append((s, a, r, s2, done))
            s = s2
            if done:
                break
        return out

    def train(self, env: GridWorld, n_episodes: int, most: int, seed: int) -> tuple[np.ndarray, list[float]]:
        """Action values (or policy parameters) and the reward of each episode."""
        rng, q, rewards = np.random.default_rng(seed), np.zeros((env.n_states, 4)), []
        n, model = np.zeros_like(q), {}
        mean, var = np.zeros_like(q), np.ones_like(q)
        for _ in range(n_episodes):
            if self.kind == "cross_entropy":
                thetas = mean + np.sqrt(var) * rng.normal(size=(self.samples, *q.shape))
                pick = lambda th: lambda s: int(rng.choice(4, p=np.exp(th[s] - th[s].max()) / np.exp(th[s] - th[s].max()).sum()))
                got = [sum(x[2] for x in self._episode(env, pick(th), most)) for th in thetas]
                best = thetas[np.argsort(got)[::-1][: max(1, int(self.keep * self.samples))]]
                mean, var, q = best.mean(0), best.var(0) + 1e-3, best.mean(0)
                rewards.append(float(np.mean(got)))
                continue
            if self.kind == "monte_carlo":
                steps = self._episode(env, lambda s: self._act(q, s, rng), most)
                g, w = 0.0, 1.0
                first = {(s, a): k for k, (s, a, *_) in reversed(list(enumerate(steps)))}
                for k in range(len(steps) - 1, -1, -1):
                    s, a, r, _, _ = steps[k]
                    g = r + self.gamma * g
                    if self.off_policy:
                        n[s, a] += w
                        q[s, a] += w / n[s, a] * (g - q[s, a])
                        if a != int(np.argmax(q[s])):
                            break
                        w /= 1 - self.epsilon + self.epsilon / 4
                    elif first[s, a] == k:
                        n[s, a] += 1
                        q[s, a] += (g - q[s, a]) / n[s, a]
            else:
                s, steps = 0, []
                for _ in range(most):
                    a = self._act(q, s, rng)
                    s2, r, done = env.step(s, a)
                    steps.append((s, a, r, s2, done))
                    self._learn(q, s, a, r, s2, done)
                    model[s, a] = (r, s2, done)
                    for _ in range(self.simulated if self.kind == "dyna" else 0):
                        (ps, pa), (pr, p2, pd_) = list(model.items())[rng.integers(len(model))]
                        self._learn(q, ps, pa, pr, p2, pd_)
                    s = s2
                    if done:
                        break
            rewards.append(float(sum(x[2] for x in steps)))
        return q, rewards

    def _learn(self, q: np.ndarray, s: int, a: int, r: float, s2: int, done: bool) -> None:
        if self.off_policy or self.kind == "dyna":
            after = q[s2].max()
        else:
            after = (1 - self.epsilon) * q[s2].max() + self.epsilon * q[s2].mean()
        q[s, a] += self.lr * (r + self.gamma * (0.0 if done else after) - q[s, a])

    def greedy(self, env: GridWorld, q: np.ndarray, most: int) -> float:
        return sum(x[2] for x in self._episode(env, lambda s: int(np.argmax(q[s])), most))


def train_agents(spark: SparkSession, agents: dict[str, Agent], env: GridWorld, n_episodes: int, most: int = 100, seeds: int = 2) -> DataFrame:
    """The log (agent, seed, episode, reward, greedy) of agents that learn in tasks of their own; greedy is the
    reward of the greedy policy in the end."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name, seed = pdf["agent"].iloc[0], int(pdf["seed"].iloc[0])
        q, rewards = agents[name].train(env, n_episodes, most, seed)
        return pd.DataFrame({"agent": name, "seed": seed, "episode": range(len(rewards)), "reward": rewards, "greedy": agents[name].greedy(env, q, most)})

    runs = spark.createDataFrame([(a, s) for a in agents for s in range(seeds)], "agent string, seed int")
    return runs.groupBy("agent", "seed").applyInPandas(run, "agent string, seed int, episode int, reward double, greedy double")
