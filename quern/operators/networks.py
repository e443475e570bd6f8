"""Layers, modules and models that learn from tables.

A step of training broadcasts the parameters, lets every task compute the gradient of its rows' loss, adds the
gradients up in Spark and updates on the driver; what reaches the driver has the size of the parameters.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import autodiff as A
from quern.functions.autodiff import Var
from quern.operators.tensor import causal_pad, fans

Params = dict[str, np.ndarray]

# --- initial weights ----------------------------------------------------------------------------------------


def truncated_normal(rng: np.random.Generator, std: float, shape) -> np.ndarray:
    """Normal numbers within two standard deviations, by rejection."""
    x = rng.normal(0, std, shape)
    while (bad := np.abs(x) > 2 * std).any():
        x[bad] = rng.normal(0, std, bad.sum())
    return x


def initial(rng: np.random.Generator, shape, mode: str = "glorot_uniform", gain: float = 1.0) -> np.ndarray:
    fan_in, fan_out = fans(shape)
    match mode:
        case "he_uniform":
            b = math.sqrt(6 / fan_in)
            return rng.uniform(-b, b, shape)
        case "he_normal":
            return truncated_normal(rng, math.sqrt(2 / fan_in), shape)
        case "glorot_uniform":
            b = gain * math.sqrt(6 / (fan_in + fan_out))
            return rng.uniform(-b, b, shape)
        case "glorot_normal":
            return truncated_normal(rng, gain * math.sqrt(2 / (fan_in + fan_out)), shape)
        case "std_normal":
            return rng.normal(0, 1, shape)
        case "trunc_normal":
            return truncated_normal(rng, 1.0, shape)
    raise ValueError(mode)


def glorot_gain(activation: str, alpha: float = 0.3) -> float:
    return {"tanh": 5 / 3, "relu": math.sqrt(2), "leaky_relu": math.sqrt(2 / (1 + alpha * alpha))}.get(activation, 1.0)


# --- layers as functions of parameters and inputs --------------------------------------------------------------


def dense(p: dict[str, Var], name: str, x: Var, act: str = "identity") -> Var:
    return A.ACTIVATIONS[act](x @ p[f"{name}.w"] + p[f"{name}.b"])


def dense_params(rng, name: str, n_in: int, n_out: int, mode: str = "glorot_uniform") -> Params:
    return {f"{name}.w": initial(rng, (n_in, n_out), mode), f"{name}.b": np.zeros(n_out)}


def conv2d(p, name: str, x: Var, stride: int = 1, pad: int = 0, dilation: int = 0, act: str = "identity") -> Var:
    """x: (examples, rows, columns, channels); weights (fr, fc, in, out)."""
    w = p[f"{name}.w"]
    d, (fr, fc, _, _) = dilation + 1, w.shape
    x = x.pad(((0, 0), (pad, pad), (pad, pad), (0, 0))) if pad else x
    oh, ow = ((n - (k - 1) * d - 1) // stride + 1 for n, k in zip(x.shape[1:3], (fr, fc), strict=True))
    out = None
    for r in range(fr):
        for c in range(fc):
            part = x[:, r * d : r * d + (oh - 1) * stride + 1 : stride, c * d : c * d + (ow - 1) * stride + 1 : stride] @ w[r, c]
            out = part if out is None else out + part
    return A.ACTIVATIONS[act](out + p[f"{name}.b"])


def deconv2d(p, name: str, x: Var, stride: int = 1, act: str = "identity") -> Var:
    """Transposed convolution: zeros between pixels, full padding, flipped kernel."""
    w = p[f"{name}.w"]
    fr, fc = w.shape[:2]
    n, h, wd, c = x.shape
    wide = x
    if stride > 1:
        zero = np.zeros((n, h, stride - 1, wd, 1, c))
        wide = A.concat([x.reshape(n, h, 1, wd, 1, c), Var(zero)], 2).reshape(n, h * stride, wd, c)[:, : (h - 1) * stride + 1]
        h = (h - 1) * stride + 1
        wide = A.concat([wide.reshape(n, h, wd, 1, c), Var(np.zeros((n, h, wd, stride - 1, c)))], 3).reshape(n, h, wd * stride, c)[:, :, : (wd - 1) * stride + 1]
    flipped = {f"{name}.w": w[::-1, ::-1], f"{name}.b": p[f"{name}.b"]}
    return conv2d(flipped, name, wide.pad(((0, 0), (fr - 1, fr - 1), (fc - 1, fc - 1), (0, 0))), act=act)


def conv1d(p, name: str, x: Var, dilation: int = 0, causal: bool = False, act: str = "identity") -> Var:
    """x: (examples, length, channels); weights (1, width, in, out)."""
    if causal:
        x = x.pad(((0, 0), causal_pad(p[f"{name}.w"].shape[1], dilation), (0, 0)))
    n, l, c = x.shape
    y = x.reshape(n, 1, l, c)
    w = p[f"{name}.w"]
    d, k = dilation + 1, w.shape[1]
    ol = l - (k - 1) * d
    out = None
    for j in range(k):
        part = y[:, 0, j * d : j * d + ol] @ w[0, j]
        out = part if out is None else out + part
    return A.ACTIVATIONS[act](out + p[f"{name}.b"])


def pool2d(x: Var, k: int, stride: int, mode: str = "max") -> Var:
    oh, ow = ((n - k) // stride + 1 for n in x.shape[1:3])
    parts = [x[:, r : r + (oh - 1) * stride + 1 : stride, c : c + (ow - 1) * stride + 1 : stride] for r in range(k) for c in range(k)]
    s = A.stack(parts, -1)
    return s.clip_max(-1) if mode == "max" else s.mean(-1)


def norm(p, name: str, x: Var, axis, eps: float = 1e-5) -> Var:
    """Batch norm over the examples' axes, or layer norm over all others."""
    d = x - x.mean(axis, True)
    return d / ((d * d).mean(axis, True) + eps) ** 0.5 * p[f"{name}.g"] + p[f"{name}.s"]


def attention(q: Var, k: Var, v: Var) -> Var:
    """Scaled dot-product attention over the axis before the last."""
    t = list(range(len(k.shape)))
    t[-1], t[-2] = t[-2], t[-1]
    return A.softmax(q @ k.transpose(*t) * (1 / math.sqrt(q.shape[-1]))) @ v


def multi_head(p, name: str, q: Var, k: Var, v: Var, heads: int) -> Var:
    """Projections, attention per head, and an output projection, for sequences of any length."""

    def split(x: Var) -> Var:
        n, l, d = x.shape
        return x.reshape(n, l, heads, d // heads).transpose(0, 2, 1, 3)

    o = attention(*(split(dense(p, f"{name}.{s}", x)) for s, x in (("q", q), ("k", k), ("v", v)))).transpose(0, 2, 1, 3)
    return dense(p, f"{name}.o", o.reshape(o.shape[0], o.shape[1], -1))


def rnn(p, name: str, x: Var) -> Var:
    """x: (examples, time, inputs) to states (examples, time, units)."""
    a, out = Var(np.zeros((x.shape[0], p[f"{name}.u"].shape[0]))), []
    for t in range(x.shape[1]):
        a = A.tanh(x[:, t] @ p[f"{name}.w"] + a @ p[f"{name}.u"] + p[f"{name}.b"])
        out.append(a)
    return A.stack(out, 1)


def lstm(p, name: str, x: Var, reverse: bool = False) -> Var:
    """Gates forget, update, candidate, output, in that order of columns."""
    n = p[f"{name}.u"].shape[0]
    a, c, out = Var(np.zeros((x.shape[0], n))), Var(np.zeros((x.shape[0], n))), []
    for t in reversed(range(x.shape[1])) if reverse else range(x.shape[1]):
        z = x[:, t] @ p[f"{name}.w"] + a @ p[f"{name}.u"] + p[f"{name}.b"]
        f, u, g, o = (z[:, k * n : (k + 1) * n] for k in range(4))
        c = A.sigmoid(f) * c + A.sigmoid(u) * A.tanh(g)
        a = A.sigmoid(o) * A.tanh(c)
        out.append(a)
    return A.stack(out[::-1] if reverse else out, 1)


def recurrent_params(rng, name: str, n_in: int, n: int, gates: int = 1) -> Params:
    return {f"{name}.w": initial(rng, (n_in, n * gates)), f"{name}.u": initial(rng, (n, n * gates)), f"{name}.b": np.zeros(n * gates)}


def bidirectional_lstm(p, name: str, x: Var, merge: str = "concat") -> Var:
    a, b = lstm(p, f"{name}.fwd", x), lstm(p, f"{name}.bwd", x, reverse=True)
    return {"concat": lambda: A.concat([a, b]), "sum": lambda: a + b, "average": lambda: (a + b) * 0.5, "multiply": lambda: a * b}[merge]()


def wavenet_block(p, name: str, x: Var, skip: Var | None, dilation: int) -> tuple[Var, Var]:
    """Dilated causal convolution, gate, 1 x 1 convolution; returns the residual and the skip sum."""
    z = conv1d(p, f"{name}.d", x, dilation, causal=True)
    y = conv1d(p, f"{name}.o", A.tanh(z) * A.sigmoid(z))
    return x + y, y if skip is None else skip + y


def residual_block(p, name: str, x: Var, stride: int = 1) -> Var:
    """Two convolutions with batch norms; the shortcut is the input, or its projection where one is given."""
    y = A.relu(norm(p, f"{name}.n1", conv2d(p, f"{name}.c1", x, stride, 1), (0, 1, 2)))
    y = norm(p, f"{name}.n2", conv2d(p, f"{name}.c2", y, 1, 1), (0, 1, 2))
    short = norm(p, f"{name}.ns", conv2d(p, f"{name}.cs", x, stride), (0, 1, 2)) if f"{name}.cs.w" in p else x
    return A.relu(y + short)


def dropout(x: Var, share: float, rng: np.random.Generator) -> Var:
    """Inverted dropout; the same mask applies to the gradient."""
    return x * ((rng.random(x.shape) >= share) / (1 - share))


def embedding(p, name: str, ids: np.ndarray, pool: str | None = None) -> Var:
    e = p[f"{name}.w"][ids]
    return e if pool is None else (e.sum(1) if pool == "sum" else e.mean(1))


# --- optimizers on the driver ---------------------------------------------------------------------------------


@dataclass
class Optimizer:
    """kind: sgd, adagrad, rmsprop, adam. clip: largest norm of a parameter's gradient."""

    kind: str = "adam"
    lr: float = 0.01
    momentum: float = 0.0
    decay: float = 0.9
    decay2: float = 0.999
    eps: float = 1e-7
    clip: float | None = None
    schedule: Callable[[int], float] | None = None
    state: dict = field(default_factory=dict)
    steps: int = 0

    def step(self, params: Params, grads: Params) -> None:
        self.steps += 1
        lr = self.schedule(self.steps) if self.schedule else self.lr
        for k, g in grads.items():
            if self.clip is not None and (n := np.linalg.norm(g)) > self.clip:
                g = g * self.clip / n
            m, v = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            match self.kind:
                case "sgd":
                    m = self.momentum * m + lr * g
                    params[k] = params[k] - m
                case "adagrad":
                    v = v + g * g
                    params[k] = params[k] - lr * g / (np.sqrt(v) + self.eps)
                case "rmsprop":
                    v = self.decay * v + (1 - self.decay) * g * g
                    params[k] = params[k] - lr * g / (np.sqrt(v) + self.eps)
                case "adam":
                    m, v = self.decay * m + (1 - self.decay) * g, self.decay2 * v + (1 - self.decay2) * g * g
                    params[k] = params[k] - lr * (m / (1 - self.decay**self.steps)) / (np.sqrt(v / (1 - self.decay2**self.steps)) + self.eps)
            self.state[k] = (m, v)


Loss = Callable[[dict[str, Var], pd.DataFrame, np.random.Generator], Var]


def gradient(df: DataFrame, params: Params, loss: Loss, seed: int = 0, only: str = "") -> tuple[float, Params]:
    """Mean loss and gradient over all rows. loss gives the sum over a batch; parameters whose names do not
    start with `only` stay fixed."""
    names = [k for k in params if k.startswith(only)]

    def run(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        total = np.zeros(2 + sum(params[k].size for k in names))
        for pdf in batches:
            if len(pdf):
                p = {k: Var(v) for k, v in params.items()}
                out = loss(p, pdf, rng)
                out.backward()
                zero = lambda k: np.zeros_like(params[k]) if p[k].grad is None else p[k].grad  # noqa: B023, E731
                total += np.concatenate([[float(out.data), len(pdf)], *(zero(k).ravel() for k in names)])
        yield pd.DataFrame({"v": [total.tolist()]})

    parts = df.mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
    v = np.array([r["v"] for r in parts.orderBy("k").collect()])
    grads, at = {}, 2
    for k in names:
        grads[k] = v[at : at + params[k].size].reshape(params[k].shape) / max(v[1], 1)
        at += params[k].size
    return float(v[0] / max(v[1], 1)), grads


def train(df: DataFrame, params: Params, loss: Loss, optimizer: Optimizer, steps: int, seed: int = 0) -> list[float]:
    """Full-batch steps; params change in place. Returns the loss before each step."""
    out = []
    for k in range(steps):
        value, grads = gradient(df, params, loss, seed + k)
        out.append(value)
        optimizer.step(params, grads)
    return out


# --- models ---------------------------------------------------------------------------------------------------


def rows(pdf: pd.DataFrame, column: str = "x") -> np.ndarray:
    return np.stack(pdf[column].to_list()).astype(float)


@dataclass
class RBM:
    """Bernoulli restricted Boltzmann machine, by contrastive divergence with k Gibbs steps."""

    n_in: int
    n_out: int
    k: int = 1
    seed: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.w, self.bv, self.bh = initial(rng, (self.n_in, self.n_out)), np.zeros(self.n_in), np.zeros(self.n_out)

    def reconstruct(self, x: np.ndarray) -> np.ndarray:
        s = lambda z: 1 / (1 + np.exp(-z))
        return s(s(x @ self.w + self.bh) @ self.w.T + self.bv)

    def fit(self, df: DataFrame, steps: int = 3, lr: float = 0.1) -> list[float]:
        """Mean squared reconstruction error before each step."""
        errors = []
        for step in range(steps):

            def run(batches, step=step):
                from pyspark import TaskContext

                rng = np.random.default_rng([self.seed, step, TaskContext.get().partitionId()])
                s = lambda z: 1 / (1 + np.exp(-z))
                total = np.zeros(2 + self.w.size + self.n_in + self.n_out)
                for pdf in batches:
                    if not len(pdf):
                        continue
                    v0 = rows(pdf)
                    h0 = s(v0 @ self.w + self.bh)
                    h = h0
                    for _ in range(self.k):
                        v = s((rng.random(h.shape) < h) @ self.w.T + self.bv)
                        h = s(v @ self.w + self.bh)
                    total += np.concatenate([[((self.reconstruct(v0) - v0) ** 2).mean(1).sum(), len(pdf)], (v0.T @ h0 - v.T @ h).ravel(), (v0 - v).sum(0), (h0 - h).sum(0)])
                yield pd.DataFrame({"v": [total.tolist()]})

            parts = df.select("x").mapInPandas(run, "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v"))
            v = np.array([r["v"] for r in parts.orderBy("k").collect()])
            n, g = max(v[1], 1), v[2:]
            errors.append(float(v[0] / n))
            self.w += lr * g[: self.w.size].reshape(self.w.shape) / n
            self.bv += lr * g[self.w.size : self.w.size + self.n_in] / n
            self.bh += lr * g[self.w.size + self.n_in :] / n
        return errors


@dataclass
class BernoulliVAE:
    """Convolutional encoder, dense decoder; square images with values in 0 .. 1."""

    side: int
    latent: int = 4
    channels: int = 4
    hidden: int = 16
    seed: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        c, m = self.channels, (self.side - 2) // 2
        self.params: Params = {"c.w": initial(rng, (3, 3, 1, c)), "c.b": np.zeros(c)}
        for name, a, b in (("h", m * m * c, self.hidden), ("m", self.hidden, self.latent), ("v", self.hidden, self.latent), ("d1", self.latent, self.hidden), ("d2", self.hidden, self.side**2)):
            self.params |= dense_params(rng, name, a, b)

    def loss(self, p: dict[str, Var], pdf: pd.DataFrame, rng: np.random.Generator) -> Var:
        x = rows(pdf)
        h = pool2d(conv2d(p, "c", Var(x.reshape(-1, self.side, self.side, 1)), act="relu"), 2, 2)
        h = dense(p, "h", h.reshape(len(x), -1), "relu")
        mean, log_var = dense(p, "m", h), dense(p, "v", h)
        z = mean + A.exp(log_var * 0.5) * rng.normal(size=mean.shape)
        logit = dense(p, "d2", dense(p, "d1", z, "relu"))
        bce = (A.softplus(logit) - logit * x).sum()
        return bce - (1.0 + log_var - mean * mean - A.exp(log_var)).sum() * 0.5

    def fit(self, df: DataFrame, steps: int = 5, optimizer: Optimizer | None = None) -> list[float]:
        return train(df, self.params, self.loss, optimizer or Optimizer("rmsprop", 0.01), steps, self.seed)


@dataclass
class WGANGP:
    """Dense generator and critic with a gradient penalty. The critic's gradient by its input is written out,
    with ReLU slopes as constants, so that the penalty can be differentiated too."""

    n: int
    hidden: int = 16
    penalty: float = 10.0
    seed: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.params: Params = {}
        for name, a, b in (("g.1", self.n, self.hidden), ("g.2", self.hidden, self.n), ("c.1", self.n, self.hidden), ("c.2", self.hidden, self.hidden), ("c.3", self.hidden, 1)):
            self.params |= dense_params(rng, name, a, b, "he_uniform")

    def generator(self, p, z: np.ndarray) -> Var:
        return dense(p, "g.2", dense(p, "g.1", Var(z), "relu"))

    def critic(self, p, x: Var) -> Var:
        return dense(p, "c.3", dense(p, "c.2", dense(p, "c.1", x, "relu"), "relu"))

    def critic_loss(self, p, pdf: pd.DataFrame, rng: np.random.Generator) -> Var:
        real = rows(pdf)
        fake = self.generator({k: Var(v.data) for k, v in p.items()}, rng.normal(size=real.shape)).data
        mixed = real + rng.random((len(real), 1)) * (fake - real)
        z1 = Var(mixed) @ p["c.1.w"] + p["c.1.b"]
        z2 = A.relu(z1) @ p["c.2.w"] + p["c.2.b"]
        slope = (p["c.3.w"].reshape(1, -1) * (z2.data > 0)) @ p["c.2.w"].transpose(1, 0) * (z1.data > 0) @ p["c.1.w"].transpose(1, 0)
        length = ((slope * slope).sum(1) + 1e-12) ** 0.5
        return self.critic(p, Var(fake)).sum() - self.critic(p, Var(real)).sum() + ((length - 1.0) ** 2.0).sum() * self.penalty

    def generator_loss(self, p, pdf: pd.DataFrame, rng: np.random.Generator) -> Var:
        return -self.critic(p, self.generator(p, rng.normal(size=(len(pdf), self.n)))).sum()

    def fit(self, df: DataFrame, steps: int = 3, critic_steps: int = 2, lr: float = 0.01) -> list[tuple[float, float]]:
        """Losses (critic, generator) of each step."""
        oc, og, out = Optimizer("rmsprop", lr), Optimizer("rmsprop", lr), []
        for k in range(steps):
            for j in range(critic_steps):
                c, grads = gradient(df, self.params, self.critic_loss, 100 * k + j, "c.")
                oc.step(self.params, grads)
            g, grads = gradient(df, self.params, self.generator_loss, 100 * k + 99, "g.")
            og.step(self.params, grads)
            out.append((c, g))
        return out


def context_pairs(tokens: DataFrame, radius: int) -> DataFrame:
    """(id, target, context) of words at most radius places apart in a document; tokens: (id, words array)."""
    near = F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.struct(F.get("words", i).alias("target"), F.concat(F.slice("words", F.greatest(i - radius, F.lit(0)) + 1, F.least(i, F.lit(radius))), F.slice("words", i + 2, radius)).alias("around")))
    own = tokens.where(F.size("words") > 0).select("id", F.explode(near).alias("n"))
    return own.select("id", F.col("n.target").alias("target"), F.explode("n.around").alias("context"))


def noise_distribution(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """(token, p): counts to a power, normalized."""
    raised = counts.withColumn("w", F.pow("count", F.lit(power)))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("w").alias("_t")))).select("token", (F.col("w") / F.col("_t")).alias("p"))


@dataclass
class Word2Vec:
    """Skip-gram with noise-contrastive estimation; word numbers below `vocabulary` with a noise distribution."""

    vocabulary: int
    noise: np.ndarray
    dims: int = 8
    negatives: int = 4
    seed: int = 0

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.params: Params = {"e.w": initial(rng, (self.vocabulary, self.dims)), "o.w": initial(rng, (self.vocabulary, self.dims)), "o.b": np.zeros(self.vocabulary)}

    def loss(self, p, pdf: pd.DataFrame, rng: np.random.Generator) -> Var:
        t, c = pdf["target"].to_numpy(), pdf["context"].to_numpy()
        neg = rng.choice(self.vocabulary, size=(len(t), self.negatives), p=self.noise)
        e, shift = p["e.w"][t], np.log(self.negatives * self.noise + 1e-12)
        good = (e * p["o.w"][c]).sum(1) + p["o.b"][c] - shift[c]
        bad = (e.reshape(len(t), 1, -1) * p["o.w"][neg]).sum(2) + p["o.b"][neg] - shift[neg]
        return A.softplus(-good).sum() + A.softplus(bad).sum()

    def fit(self, pairs: DataFrame, steps: int = 3, optimizer: Optimizer | None = None) -> list[float]:
        return train(pairs, self.params, self.loss, optimizer or Optimizer("adam", 0.05), steps, self.seed)

    def embedding(self, ids) -> np.ndarray:
        return self.params["e.w"][ids]


@dataclass
class SparseEvolution:
    """A dense layer with few weights: after a step the weakest share zeta of them moves to new places."""

    n_in: int
    n_out: int
    zeta: float = 0.3
    density: float = 0.2
    seed: int = 0

    def __post_init__(self):
        self.rng = np.random.default_rng(self.seed)
        self.mask = self.rng.random((self.n_in, self.n_out)) < self.density
        self.w = initial(self.rng, self.mask.shape) * self.mask

    def evolve(self) -> None:
        on = np.flatnonzero(self.mask)
        drop = on[np.argsort(np.abs(self.w.ravel()[on]))[: int(self.zeta * len(on))]]
        free = np.setdiff1d(np.arange(self.mask.size), on)
        new = self.rng.choice(free, size=min(len(drop), len(free)), replace=False)
        self.mask.ravel()[drop], self.w.ravel()[drop] = False, 0.0
        self.mask.ravel()[new], self.w.ravel()[new] = True, self.rng.normal(0, 0.1, len(new))
