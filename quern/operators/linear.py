"""Linear models on named columns. What is fitted follows from one row of sums, whatever the size of the table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def terms(features: Sequence[str], intercept: bool = True) -> list[Column]:
    return ([F.lit(1.0)] if intercept else []) + [F.col(f).cast("double") for f in features]


def linear(beta: Sequence[float], x: Sequence[Column]) -> Column:
    return sum((c * float(b) for b, c in zip(beta, x, strict=True)), F.lit(0.0))


@dataclass
class Sums:
    """Weighted sums of products: xx (M x M), xy (M x K), and yy, n. They add up over parts of a table."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: float

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n)


def sums(df: DataFrame, x: Sequence[Column], y: Sequence[Column], weight: Column | None = None) -> Sums:
    """One aggregation without a shuffle of rows; only the sums reach the driver."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    m, k = len(x), len(y)
    exprs = [F.sum(w * x[i] * x[j]) for i in range(m) for j in range(i, m)] + [F.sum(w * a * b) for a in x for b in y] + [F.sum(w * b * b) for b in y] + [F.count("*")]
    row = [float(v or 0.0) for v in df.agg(*(e.alias(f"s{i}") for i, e in enumerate(exprs))).first()]
    xx = np.zeros((m, m))
    upper = [(i, j) for i in range(m) for j in range(i, m)]
    for (i, j), v in zip(upper, row, strict=False):
        xx[i, j] = xx[j, i] = v
    rest = row[len(upper) :]
    return Sums(xx, np.array(rest[: m * k]).reshape(m, k), np.array(rest[m * k : m * k + k]), rest[-1])


@dataclass
class LinearRegression:
    """Least squares, with weights and several targets; update() takes more rows exactly as if fitted at once."""

    features: Sequence[str]
    targets: Sequence[str]
    intercept: bool = True
    penalty: float = 0.0
    total: Sums | None = field(default=None, repr=False)
    beta: np.ndarray | None = None

    def fit(self, df: DataFrame, weight: str | None = None) -> LinearRegression:
        self.total = None
        return self.update(df, weight)

    def update(self, df: DataFrame, weight: str | None = None) -> LinearRegression:
        s = sums(df, terms(self.features, self.intercept), [F.col(t).cast("double") for t in self.targets], None if weight is None else F.col(weight))
        self.total = s if self.total is None else self.total + s
        self.beta = np.linalg.pinv(self.total.xx + self.penalty * np.eye(len(s.xx))) @ self.total.xy
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        x = terms(self.features, self.intercept)
        return df.withColumns({f"{t}_hat": linear(self.beta[:, k], x) for k, t in enumerate(self.targets)})


def RidgeRegression(features: Sequence[str], targets: Sequence[str], alpha: float = 1.0, intercept: bool = True) -> LinearRegression:  # noqa: N802
    """(X'X + alpha I)^-1 X'y; the intercept is penalized as well."""
    return LinearRegression(features, targets, intercept, alpha)


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


@dataclass
class LogisticRegression:
    """Gradient descent on the mean negative log-likelihood plus gamma / 2 |b|^2 or gamma |b|, per row."""

    features: Sequence[str]
    target: str
    penalty: str = "l2"
    gamma: float = 0.0
    intercept: bool = True
    beta: np.ndarray | None = None
    losses: list[float] = field(default_factory=list)

    def loss_and_gradient(self, df: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray]:
        x, y = terms(self.features, self.intercept), F.col(self.target).cast("double")
        z = linear(beta, x)
        nll = F.sum(F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z)
        row = df.agg(F.count("*").alias("n"), nll.alias("nll"), *(F.sum((sigmoid(z) - y) * c).alias(f"g{i}") for i, c in enumerate(x))).first()
        n = max(row["n"], 1)
        cost, slope = (0.5 * beta @ beta, beta) if self.penalty == "l2" else (np.abs(beta).sum(), np.sign(beta))
        return ((row["nll"] or 0.0) + self.gamma * cost) / n, (np.array([row[f"g{i}"] or 0.0 for i in range(len(x))]) + self.gamma * slope) / n

    def fit(self, df: DataFrame, lr: float = 0.1, tol: float = 1e-7, max_iter: int = 100) -> LogisticRegression:
        self.beta, last = np.zeros(len(self.features) + self.intercept), math.inf
        for _ in range(max_iter):
            loss, g = self.loss_and_gradient(df, self.beta)
            self.losses.append(loss)
            if last - loss < tol:
                break
            self.beta, last = self.beta - lr * g, loss
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("probability", sigmoid(linear(self.beta, terms(self.features, self.intercept))))


#: Canonical links: name -> (mean of eta, derivative of the mean, eta of a mean).
LINKS = {
    "identity": (lambda e: e, lambda e: F.lit(1.0), lambda m: m),
    "log": (F.exp, F.exp, math.log),
    "logit": (sigmoid, lambda e: sigmoid(e) * (1.0 - sigmoid(e)), lambda m: math.log(m / (1 - m))),
}


@dataclass
class GeneralizedLinearModel:
    """Iteratively reweighted least squares with a canonical link."""

    features: Sequence[str]
    target: str
    link: str = "identity"
    intercept: bool = True
    beta: np.ndarray | None = None

    def step(self, df: DataFrame, beta: np.ndarray) -> np.ndarray:
        mean, slope, _ = LINKS[self.link]
        x = terms(self.features, self.intercept)
        eta = linear(beta, x)
        s = sums(df, x, [eta + (F.col(self.target) - mean(eta)) / slope(eta)], slope(eta))
        return np.linalg.pinv(s.xx) @ s.xy[:, 0]

    def fit(self, df: DataFrame, tol: float = 1e-6, max_iter: int = 25) -> GeneralizedLinearModel:
        m = df.agg(F.avg(self.target)).first()[0]
        self.beta = np.zeros(len(self.features) + self.intercept)
        if self.intercept:
            self.beta[0] = LINKS[self.link][2](m)
        for _ in range(max_iter):
            new = self.step(df, self.beta)
            done = np.abs(new - self.beta).sum() <= tol * len(new)
            self.beta = new
            if done:
                break
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        return df.withColumn("mean", LINKS[self.link][0](linear(self.beta, terms(self.features, self.intercept))))


@dataclass
class GaussianNBClassifier:
    """Per class: means, population variances plus eps, prior; ties go to the smallest label."""

    features: Sequence[str]
    label: str
    eps: float = 1e-6
    stats: DataFrame | None = None

    def fit(self, df: DataFrame) -> GaussianNBClassifier:
        own = [F.count("*").alias("_n")]
        for f in self.features:
            own += [F.avg(f).alias(f"{f}_mean"), (F.var_pop(f) + self.eps).alias(f"{f}_var")]
        per = df.groupBy(F.col(self.label).alias("_label")).agg(*own)
        self.stats = per.crossJoin(F.broadcast(per.agg(F.sum("_n").alias("_total")))).withColumn("prior", F.col("_n") / F.col("_total")).drop("_total")
        return self

    def predict(self, df: DataFrame, most: int = 1_000) -> DataFrame:
        """Adds prediction. Class parameters become expressions; more than `most` classes are refused."""
        classes = self.stats.orderBy("_label").limit(most + 1).collect()
        if len(classes) > most:
            raise ValueError(f"more than {most} classes")
        score = F.array(*(F.struct(self._log_posterior(c).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(classes)))
        labels = F.array(*(F.lit(c["_label"]) for c in classes))
        return df.withColumn("prediction", F.element_at(labels, (1 - F.array_max(score)["i"]).cast("int")))

    def _log_posterior(self, c) -> Column:
        out = F.lit(math.log(c["prior"]))
        for f in self.features:
            m, v = c[f"{f}_mean"], c[f"{f}_var"]
            out = out - 0.5 * math.log(2 * math.pi * v) - 0.5 * (F.col(f) - m) * (F.col(f) - m) / v
        return out


@dataclass
class BayesianLinearRegression:
    """Conjugate normal prior N(mu, v) of the weights. With sigma the noise variance is known; without, it has
    an inverse-gamma prior (alpha, beta). Posteriors need M x M sums only."""

    features: Sequence[str]
    target: str
    mu: float = 0.0
    v: float = 1.0
    sigma: float | None = None
    alpha: float = 1.0
    beta: float = 2.0
    intercept: bool = True

    def fit(self, df: DataFrame) -> BayesianLinearRegression:
        s = sums(df, terms(self.features, self.intercept), [F.col(self.target).cast("double")])
        mu, prior = np.full(len(s.xx), self.mu), np.eye(len(s.xx)) / self.v
        self.precision = prior + s.xx
        self.mean = np.linalg.solve(self.precision, prior @ mu + s.xy[:, 0])
        if self.sigma is None:
            self.shape = 2 * self.alpha + s.n
            rest = s.yy[0] + mu @ prior @ mu - self.mean @ self.precision @ self.mean
            self.scale = (2 * self.beta + rest) / self.shape
        else:
            self.scale = self.sigma**2
        self.cov = self.scale * np.linalg.inv(self.precision)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds the predictive mean and variance."""
        x = terms(self.features, self.intercept)
        var = sum((a * b * float(self.cov[i, j]) for i, a in enumerate(x) for j, b in enumerate(x)), F.lit(float(self.scale)))
        return df.withColumn("mean", linear(self.mean, x)).withColumn("variance", var)
