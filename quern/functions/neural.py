"""Element-wise neural functions as columns: activations with derivatives, losses, schedules, optimizer folds."""

from __future__ import annotations

import ast
import math
from collections import deque
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.vector import softmax  # noqa: F401

EPS = 2.220446049250313e-16
#: Fixed values of the self-normalizing activation.
SELU_ALPHA, SELU_SCALE = 1.6732632423543772848170429916717, 1.0507009873554804934193349852946


@dataclass(frozen=True)
class Activation:
    """fn, grad and grad2 of a column."""

    name: str
    alpha: float = 0.0
    beta: float = 0.0

    def fn(self, z: Column) -> Column:
        a, b = self.alpha, self.beta
        match self.name:
            case "sigmoid":
                return 1.0 / (1.0 + F.exp(-z))
            case "relu":
                return F.greatest(z, F.lit(0.0))
            case "leaky_relu":
                return F.when(z < 0, a * z).otherwise(z)
            case "gelu":
                return 0.5 * z * (1.0 + F.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z * z * z)))
            case "gelu_exact":
                return z * normal_cdf(z)
            case "tanh":
                return F.tanh(z)
            case "affine":
                return a * z + b
            case "identity":
                return z
            case "elu":
                return F.when(z > 0, z).otherwise(a * (F.exp(F.least(z, F.lit(0.0))) - 1.0))
            case "exponential":
                return F.exp(z)
            case "selu":
                return SELU_SCALE * F.when(z > 0, z).otherwise(SELU_ALPHA * (F.exp(F.least(z, F.lit(0.0))) - 1.0))
            case "hard_sigmoid":
                return F.least(F.greatest(0.2 * z + 0.5, F.lit(0.0)), F.lit(1.0))
            case "softplus":
                return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))  # no overflow
        raise ValueError(self.name)

    def grad(self, z: Column) -> Column:
        a = self.alpha
        match self.name:
            case "sigmoid":
                return self.fn(z) * (1.0 - self.fn(z))
            case "relu":
                return (z > 0).cast("double")
            case "leaky_relu":
                return F.when(z < 0, a).otherwise(1.0)
            case "gelu":
                c, t = math.sqrt(2 / math.pi), F.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z * z * z))
                return 0.5 * (1.0 + t) + 0.5 * z * (1.0 - t * t) * c * (1.0 + 3 * 0.044715 * z * z)
            case "gelu_exact":
                return normal_cdf(z) + z * normal_pdf(z)
            case "tanh":
                return 1.0 - F.tanh(z) * F.tanh(z)
            case "affine":
                return F.lit(a) + 0.0 * z
            case "identity":
                return F.lit(1.0) + 0.0 * z
            case "elu":
                return F.when(z > 0, 1.0).otherwise(a * F.exp(F.least(z, F.lit(0.0))))
            case "exponential":
                return F.exp(z)
            case "selu":
                return SELU_SCALE * F.when(z > 0, 1.0).otherwise(SELU_ALPHA * F.exp(F.least(z, F.lit(0.0))))
            case "hard_sigmoid":
                return F.when((z >= -2.5) & (z <= 2.5), 0.2).otherwise(0.0)
            case "softplus":
                return 1.0 / (1.0 + F.exp(-z))
        raise ValueError(self.name)

    def grad2(self, z: Column) -> Column:
        match self.name:
            case "sigmoid":
                return self.grad(z) * (1.0 - 2.0 * self.fn(z))
            case "gelu_exact":
                return normal_pdf(z) * (2.0 - z * z)
            case "gelu":
                c, k = math.sqrt(2 / math.pi), 0.044715
                t = F.tanh(c * (z + k * z * z * z))
                u1, u2 = c * (1.0 + 3 * k * z * z), 6 * c * k * z
                return (1.0 - t * t) * (u1 + 0.5 * z * u2 - z * t * u1 * u1)
            case "tanh":
                return -2.0 * F.tanh(z) * (1.0 - F.tanh(z) * F.tanh(z))
            case "elu":
                return F.when(z > 0, 0.0).otherwise(self.alpha * F.exp(F.least(z, F.lit(0.0))))
            case "exponential":
                return F.exp(z)
            case "selu":
                return F.when(z > 0, 0.0).otherwise(SELU_SCALE * SELU_ALPHA * F.exp(F.least(z, F.lit(0.0))))
            case "softplus":
                return Activation("sigmoid").grad(z)
        return F.lit(0.0) * z  # piecewise linear


#: Coefficients of the error function's approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(z: Column, mean: float = 0.0, variance: float = 1.0) -> Column:
    x = F.abs(z - mean) / math.sqrt(2 * variance)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = F.lit(0.0)
    for c in reversed(ERF):
        poly = (poly + c) * t
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < mean, -erf).otherwise(erf))


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


ACTIVATIONS = {
    "sigmoid": Activation("sigmoid"), "relu": Activation("relu"), "leaky_relu": Activation("leaky_relu", 0.3), "gelu": Activation("gelu"),
    "gelu_exact": Activation("gelu_exact"), "tanh": Activation("tanh"), "affine": Activation("affine", 1.0, 0.0), "identity": Activation("identity"),
    "elu": Activation("elu", 1.0), "exponential": Activation("exponential"), "selu": Activation("selu"), "hard_sigmoid": Activation("hard_sigmoid"),
    "softplus": Activation("softplus"),
}


def parsed(text: str) -> tuple[str, dict]:
    """A name and its keyword arguments, such as "sgd(lr=0.1)"; values are literals."""
    call = ast.parse(text if "(" in text else f"{text}()", mode="eval").body
    if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name) or call.args:
        raise ValueError(f"not a call: {text}")
    return call.func.id, {k.arg: ast.literal_eval(k.value) for k in call.keywords}


def activation(spec: str | Activation | None = None) -> Activation:
    """From nothing (identity), a name with arguments such as "leaky_relu(alpha=0.1)", or itself."""
    if spec is None:
        return ACTIVATIONS["identity"]
    if isinstance(spec, Activation):
        return spec
    name, args = parsed(spec)
    known = {"".join(c for c in k if c != "_"): v for k, v in ACTIVATIONS.items()}
    base = known[name.lower().replace("_", "")]
    return Activation(base.name, args.get("alpha", args.get("slope", base.alpha)), args.get("intercept", base.beta))


# --- losses over arrays -----------------------------------------------------------------------------------


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def squared_error(y: Column, p: Column) -> Column:
    """Half the squared distance of a row."""
    return 0.5 * _sum(F.zip_with(y, p, lambda a, b: (b - a) * (b - a)))


def cross_entropy(y: Column, p: Column) -> Column:
    return -_sum(F.zip_with(y, p, lambda a, b: a * F.log(b + EPS)))


def vae_loss(y: Column, p: Column, mean: Column, log_var: Column) -> Column:
    """Binary cross-entropy plus the divergence from a standard normal, of a row."""
    clipped = lambda b: F.least(F.greatest(b, F.lit(EPS)), F.lit(1 - EPS))
    bce = -_sum(F.zip_with(y, p, lambda a, b: a * F.log(clipped(b)) + (1.0 - a) * F.log(1.0 - clipped(b))))
    return bce - 0.5 * _sum(F.zip_with(mean, log_var, lambda m, v: 1.0 + v - m * m - F.exp(v)))


def nce_loss(positive: Column, negatives: Column) -> Column:
    """Binary cross-entropy of a target's logit and the logits of noise words."""
    softplus = ACTIVATIONS["softplus"].fn
    return softplus(-positive) + _sum(F.transform(negatives, softplus))


# --- schedules --------------------------------------------------------------------------------------------


def constant_schedule(step: Column, lr: float = 0.01) -> Column:
    return F.lit(lr) + 0.0 * step


def exponential_schedule(step: Column, lr: float = 0.01, stage: int = 500, staircase: bool = False, decay: float = 0.1) -> Column:
    k = step / float(stage)
    return lr * F.pow(F.lit(decay), F.floor(k) if staircase else k)


def noam_schedule(step: Column, dim: int = 512, scale: float = 1.0, warmup: int = 4000) -> Column:
    """Null at step 0."""
    s = F.when(step > 0, step.cast("double"))
    return scale * dim**-0.5 * F.least(F.pow(s, F.lit(-0.5)), s * warmup**-1.5)


def falling_probability(losses: np.ndarray) -> float:
    """The probability that a least-squares line through equally spaced losses falls, its slope being normal
    around the estimate with the estimate's variance. Fewer than three losses count as falling."""
    n = len(losses)
    if n < 3:
        return 1.0
    t = np.arange(n) - (n - 1) / 2
    around = losses - losses.mean()
    slope = (t @ around) / (t @ t)
    rest = around - slope * t
    spread = math.sqrt((rest @ rest) / (n - 2) / (t @ t))
    return NormalDist(slope, spread).cdf(0.0) if spread > 0 else float(slope < 0)


@dataclass
class KingScheduler:
    """Decays the rate when the last `patience` steps say "falling" with a probability below `sure`, both for the
    losses as they are and without the largest tenth of those kept. Enough of them are kept that patience + 1
    remain without that tenth. After a decay the losses so far no longer count."""

    lr: float = 0.01
    patience: int = 1000
    decay: float = 0.99
    sure: float = 0.51
    losses: deque[float] = field(init=False)

    def __post_init__(self) -> None:
        self.losses = deque(maxlen=math.ceil((self.patience + 1) / 0.9) + 1)

    def stalled(self, losses: np.ndarray) -> bool:
        recent = losses[-(self.patience + 1) :]
        return len(recent) > self.patience and falling_probability(recent) < self.sure

    def __call__(self, loss: float) -> float:
        self.losses.append(float(loss))
        kept = np.array(self.losses)
        if self.stalled(kept) and self.stalled(kept[kept <= np.quantile(kept, 0.9)]):
            self.lr *= self.decay
            self.losses.clear()
        return self.lr


# --- optimizers as folds over an ordered array of gradients ------------------------------------------------


def _fold(grads: Column, start: dict[str, float], step) -> Column:
    """Parameters after each gradient; step maps (state, gradient) to a new state of the same fields."""
    zero = F.struct(*(F.lit(float(v)).alias(k) for k, v in start.items()), F.array().cast("array<double>").alias("out"))

    def merge(acc: Column, g: Column) -> Column:
        new = step({k: acc[k] for k in start}, g)
        return F.struct(*(new[k].alias(k) for k in start), F.concat(acc["out"], F.array(new["w"])).alias("out"))

    return F.aggregate(grads, zero, merge)["out"]


def clipped(g: Column, norm: float | None) -> Column:
    return g if norm is None else F.when(F.abs(g) > norm, norm * F.signum(g)).otherwise(g)


def sgd(grads: Column, w: float = 0.0, lr: float = 0.01, momentum: float = 0.0, clip: float | None = None) -> Column:
    def step(s, g):
        u = momentum * s["u"] + lr * clipped(g, clip)
        return {"w": s["w"] - u, "u": u}

    return _fold(grads, {"w": w, "u": 0.0}, step)


def adagrad(grads: Column, w: float = 0.0, lr: float = 0.01, eps: float = 1e-7) -> Column:
    def step(s, g):
        c = s["c"] + g * g
        return {"w": s["w"] - lr * g / (F.sqrt(c) + eps), "c": c}

    return _fold(grads, {"w": w, "c": 0.0}, step)


def rmsprop(grads: Column, w: float = 0.0, lr: float = 0.001, decay: float = 0.9, eps: float = 1e-7) -> Column:
    def step(s, g):
        c = decay * s["c"] + (1 - decay) * g * g
        return {"w": s["w"] - lr * g / (F.sqrt(c) + eps), "c": c}

    return _fold(grads, {"w": w, "c": 0.0}, step)


def adam(grads: Column, w: float = 0.0, lr: float = 0.001, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-7) -> Column:
    def step(s, g):
        m, v, t = b1 * s["m"] + (1 - b1) * g, b2 * s["v"] + (1 - b2) * g * g, s["t"] + 1
        m_hat, v_hat = m / (1 - F.pow(F.lit(b1), t)), v / (1 - F.pow(F.lit(b2), t))
        return {"w": s["w"] - lr * m_hat / (F.sqrt(v_hat) + eps), "m": m, "v": v, "t": t}

    return _fold(grads, {"w": w, "m": 0.0, "v": 0.0, "t": 0.0}, step)


# --- layers over arrays ------------------------------------------------------------------------------------


def matrix(rows) -> Column:
    return F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in rows))


def dense(x: Column, columns, bias, act: Activation) -> Column:
    """act(x W + b), W given by its columns."""
    from quern.functions.vector import dot

    return F.zip_with(F.transform(matrix(columns), lambda c: dot(x, c)), F.array(*(F.lit(float(b)) for b in bias)), lambda z, b: act.fn(z + b))


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    n = F.size(x)
    mean = _sum(x) / n
    return F.get(F.transform(F.array(F.struct(mean.alias("m"), (_sum(F.transform(x, lambda v: v * v)) / n - mean * mean).alias("v"))), lambda s: F.transform(x, lambda v: (v - s["m"]) / F.sqrt(s["v"] + eps))), 0)


def pad1d(x: Column, left: int, right: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), left), x, F.array_repeat(F.lit(0.0), right))


def rnn(xs: Column, wax, waa, b, act: Activation) -> Column:
    """Hidden states after each input of an array of arrays: act(W x + U a + b); rows of wax and waa belong to units."""
    from quern.functions.vector import dot

    units = len(b)
    zero = F.struct(F.array(*[F.lit(0.0)] * units).alias("a"), F.array().cast("array<array<double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = F.array(*(act.fn(dot(x, matrix([wax[u]])[0]) + dot(acc["a"], matrix([waa[u]])[0]) + float(b[u])) for u in range(units)))
        return F.struct(a.alias("a"), F.concat(acc["out"], F.array(a)).alias("out"))

    return F.aggregate(xs, zero, step)["out"]
