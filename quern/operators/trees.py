"""Decision trees, forests and boosting, grown level by level from histograms.

A level takes one pass: rows are folded into counts per (node, feature, value) before the shuffle, so what moves
is bounded by nodes x features x values. Features with more distinct values than max_bins are cut at
approximate quantiles first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CRITERIA = ("entropy", "gini", "mse")


def impurity(counts: Sequence[Column], criterion: str) -> Column:
    """Of class counts: entropy in bits or Gini. Of (n, sum, sum of squares): the mean squared deviation."""
    if criterion == "mse":
        n, s, ss = counts
        return F.greatest(ss / n - (s / n) * (s / n), F.lit(0.0))
    total = reduce(lambda a, b: a + b, counts)
    shares = [F.try_divide(c, total) for c in counts]
    if criterion == "gini":
        return 1.0 - reduce(lambda a, b: a + b, [p * p for p in shares])
    return -reduce(lambda a, b: a + b, [F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in shares])


def group_impurity(df: DataFrame, group: str, target: str, criterion: str) -> DataFrame:
    """Impurity of a target within groups (group, impurity)."""
    if criterion == "mse":
        return df.groupBy(group).agg(F.var_pop(target).alias("impurity"))
    per = df.groupBy(group, target).agg(F.count("*").alias("c")).groupBy(group).agg(F.collect_list("c").alias("c"))
    total = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, b: a + b)
    shares = F.transform("c", lambda c: c / total)
    score = F.aggregate(shares, F.lit(0.0), lambda a, p: a + (p * p if criterion == "gini" else p * F.log2(p)))
    return per.select(group, (1.0 - score if criterion == "gini" else -score).alias("impurity"))


@dataclass
class Node:
    value: tuple[float, ...]
    feature: str | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1


@dataclass
class DecisionTree:
    """features: columns; classes: labels of a classifier, or None for regression by mean squared error.
    n_feats: how many features each node may choose from (seeded). Only splits with a positive gain and two
    children that have rows are taken."""

    features: Sequence[str]
    target: str
    classes: Sequence | None = None
    max_depth: int = 3
    criterion: str = "entropy"
    n_feats: int | None = None
    seed: int = 0
    max_bins: int = 256
    nodes: list[Node] = field(default_factory=list)

    def _stats(self, weight: Column) -> list[Column]:
        y = F.col(self.target)
        if self.classes is None:
            return [F.sum(weight), F.sum(weight * y), F.sum(weight * y * y)]
        return [F.sum(F.when(y == c, weight).otherwise(0.0)) for c in self.classes]

    @property
    def _criterion(self) -> str:
        return "mse" if self.classes is None else self.criterion

    def _value(self, row) -> tuple[float, ...]:
        s = [float(row[f"s{k}"] or 0.0) for k in range(3 if self.classes is None else len(self.classes))]
        if self.classes is None:
            return (s[1] / s[0] if s[0] else 0.0,)
        return tuple(v / sum(s) if sum(s) else 0.0 for v in s)

    def binned(self, df: DataFrame) -> DataFrame:
        """df with features of too many values cut to their quantiles."""
        many = df.agg(*(F.approx_count_distinct(f).alias(f) for f in self.features)).first()
        cut = [f for f in self.features if many[f] > self.max_bins]
        if not cut:
            return df
        edges = dict(zip(cut, df.approxQuantile(cut, [k / self.max_bins for k in range(1, self.max_bins)], 1e-3), strict=True))
        place = lambda f: F.coalesce(F.array_max(F.filter(F.array(*map(F.lit, sorted(set(edges[f])))), lambda e: e <= F.col(f))), F.lit(min(edges[f]) - 1.0))
        return df.withColumns({f: place(f) for f in cut})

    def histogram(self, df: DataFrame, node: Column, weight: Column) -> DataFrame:
        """(node, f, v, s0, ...): statistics of the rows of each node by feature value."""
        long = df.withColumn("_node", node).withColumn("_w", weight).where("_node is not null")
        long = long.withColumn("_x", F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f).cast("double").alias("v")) for i, f in enumerate(self.features)))))
        return long.groupBy(F.col("_node").alias("node"), F.col("_x.f").alias("f"), F.col("_x.v").alias("v")).agg(*(s.alias(f"s{k}") for k, s in enumerate(self._stats(F.col("_w")))))

    def splits(self, hist: DataFrame) -> DataFrame:
        """(node, f, threshold, gain, s0 ..): every threshold between two values with its gain."""
        k = 3 if self.classes is None else len(self.classes)
        order = W.partitionBy("node", "f").orderBy("v")
        left = [F.sum(f"s{i}").over(order.rowsBetween(W.unboundedPreceding, 0)) for i in range(k)]
        whole = [F.sum(f"s{i}").over(W.partitionBy("node", "f")) for i in range(k)]
        h = hist.withColumns({f"l{i}": c for i, c in enumerate(left)} | {f"t{i}": c for i, c in enumerate(whole)} | {"next": F.lead("v").over(order)}).where("next is not null")
        cols = lambda p: [F.col(f"{p}{i}") for i in range(k)]
        right = [F.col(f"t{i}") - F.col(f"l{i}") for i in range(k)]
        size = lambda c: c[0] if self.classes is None else reduce(lambda a, b: a + b, c)
        gain = impurity(cols("t"), self._criterion) - (size(cols("l")) * impurity(cols("l"), self._criterion) + size(right) * impurity(right, self._criterion)) / size(cols("t"))
        return h.withColumn("gain", gain).withColumn("threshold", (F.col("v") + F.col("next")) / 2)

    def best(self, splits: DataFrame) -> DataFrame:
        """The split of each node with the largest gain; ties go to the first feature and the lowest threshold."""
        key = F.struct(F.round("gain", 12), -F.col("f"), -F.col("threshold"))
        k = 3 if self.classes is None else len(self.classes)
        return splits.groupBy("node").agg(F.max_by(F.struct("f", "threshold", "gain", *(f"l{i}" for i in range(k)), *(f"t{i}" for i in range(k))), key).alias("b")).select("node", "b.*")

    def fit(self, df: DataFrame, weight: Column | None = None) -> DecisionTree:
        weight = F.lit(1.0) if weight is None else weight
        df = self.binned(df)
        root = df.agg(*(s.alias(f"s{k}") for k, s in enumerate(self._stats(weight)))).first()
        self.nodes, open_ = [Node(self._value(root))], [0]
        rng = np.random.default_rng(self.seed)
        k = 3 if self.classes is None else len(self.classes)
        for _ in range(self.max_depth):
            at = self._route()
            splits = self.splits(self.histogram(df, F.when(at.isin(open_), at), weight))
            if self.n_feats is not None and self.n_feats < len(self.features):
                allowed = {n: rng.choice(len(self.features), self.n_feats, replace=False).tolist() for n in open_}
                splits = splits.where(reduce(lambda a, b: a | b, [(F.col("node") == n) & F.col("f").isin(fs) for n, fs in allowed.items()]))
            found = self.best(splits).where("gain > 1e-12").collect()  # a row per open node at most
            open_ = []
            for r in sorted(found, key=lambda r: r["node"]):
                n = self.nodes[r["node"]]
                n.feature, n.threshold, n.left, n.right = self.features[r["f"]], r["threshold"], len(self.nodes), len(self.nodes) + 1
                self.nodes.append(Node(self._value({f"s{i}": r[f"l{i}"] for i in range(k)})))
                self.nodes.append(Node(self._value({f"s{i}": r[f"t{i}"] - r[f"l{i}"] for i in range(k)})))
                open_ += [n.left, n.right]
            if not open_:
                break
        return self

    def _route(self, leaf=lambda i: F.lit(i), at: int = 0) -> Column:
        n = self.nodes[at]
        if n.feature is None:
            return leaf(at)
        return F.when(F.col(n.feature) < n.threshold, self._route(leaf, n.left)).otherwise(self._route(leaf, n.right))

    def class_probabilities(self) -> Column:
        return self._route(lambda i: F.array(*map(F.lit, self.nodes[i].value)))

    def prediction(self) -> Column:
        """The commonest class of a leaf (the first of equals), or its mean."""
        if self.classes is None:
            return self._route(lambda i: F.lit(self.nodes[i].value[0]))
        return self._route(lambda i: F.lit(self.classes[int(np.argmax(self.nodes[i].value))]))

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())


def poisson(key: Column, seed: int) -> Column:
    """A bootstrap weight: a Poisson(1) number that follows from a key, the same on every run."""
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)
    steps = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]
    return reduce(lambda a, b: a + b, [(u > s).cast("double") for s in steps])


@dataclass
class RandomForest:
    features: Sequence[str]
    target: str
    key: str
    classes: Sequence | None = None
    n_trees: int = 5
    max_depth: int = 3
    n_feats: int | None = None
    criterion: str = "entropy"
    seed: int = 0
    trees: list[DecisionTree] = field(default_factory=list)

    def fit(self, df: DataFrame) -> RandomForest:
        self.trees = [
            DecisionTree(self.features, self.target, self.classes, self.max_depth, self.criterion, self.n_feats, self.seed + t).fit(df, poisson(F.col(self.key), self.seed + t))
            for t in range(self.n_trees)
        ]
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """The mean, or the class with most votes (the first of equals)."""
        own = [t.prediction() for t in self.trees]
        if self.classes is None:
            return df.withColumn("prediction", reduce(lambda a, b: a + b, own) / len(own))
        return df.withColumn("prediction", vote(own, self.classes))


def vote(predictions: Sequence[Column], classes: Sequence) -> Column:
    votes = [F.struct(reduce(lambda a, b: a + b, [(p == c).cast("int") for p in predictions]).alias("n"), F.lit(-i).alias("i")) for i, c in enumerate(classes)]
    return F.element_at(F.array(*map(F.lit, classes)), 1 - F.array_max(F.array(*votes))["i"])


def loss_gradient(y: Column, p: Column, loss: str, n: int = 1) -> Column:
    """Mean squared error: -2 / n (y - p). Cross-entropy: -y / (p + eps)."""
    return -2.0 / n * (y - p) if loss == "mse" else -y / (p + 2.220446049250313e-16)


@dataclass
class GradientBoostedDecisionTree:
    """Each round fits a regression tree per output to the negative gradient; base predictions are the mean or
    the class shares. With a constant step the learning rate applies to every tree; adaptive steps are found
    by a line search of the squared error."""

    features: Sequence[str]
    target: str
    classes: Sequence | None = None
    n_iter: int = 3
    max_depth: int = 2
    learning_rate: float = 1.0
    loss: str = "mse"
    step_size: str = "constant"
    base: list[float] = field(default_factory=list)
    trees: list[list[tuple[float, DecisionTree]]] = field(default_factory=list)

    def _targets(self) -> list[Column]:
        y = F.col(self.target)
        return [y.cast("double")] if self.classes is None else [(y == c).cast("double") for c in self.classes]

    def scores(self) -> list[Column]:
        return [reduce(lambda a, b: a + b, [t.prediction() * w for w, t in trees], F.lit(b)) for b, trees in zip(self.base, self.trees, strict=True)]

    def fit(self, df: DataFrame) -> GradientBoostedDecisionTree:
        targets = self._targets()
        row = df.agg(*(F.avg(t) for t in targets)).first()
        self.base, self.trees = [float(v) for v in row], [[] for _ in targets]
        for _ in range(self.n_iter):
            for k, (y, p) in enumerate(zip(targets, self.scores(), strict=True)):
                # the mean factor of the squared error is left to the step
                rows = df.withColumn("_g", -loss_gradient(y, p, self.loss))
                tree = DecisionTree(self.features, "_g", None, self.max_depth).fit(rows)
                step = self.learning_rate
                if self.step_size == "adaptive":
                    h = tree.prediction()
                    a = rows.agg(F.sum((y - p) * h), F.sum(h * h)).first()
                    step *= (a[0] or 0.0) / a[1] if a[1] else 0.0
                elif self.loss == "mse":
                    step *= 0.5  # the gradient is -2 (y - p)
                self.trees[k].append((step, tree))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        s = self.scores()
        if self.classes is None:
            return df.withColumn("prediction", s[0])
        best = F.array_max(F.array(*(F.struct(c.alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(s))))
        return df.withColumn("prediction", F.element_at(F.array(*map(F.lit, self.classes)), 1 - best["i"]))
