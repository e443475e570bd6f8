"""A small reverse-mode differentiation of NumPy arrays, for models that are trained on batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


class Var:
    """An array, what it was made from, and after backward() its gradient."""

    def __init__(self, data, parents: Sequence[tuple[Var, Callable[[np.ndarray], np.ndarray]]] = ()):
        self.data = np.asarray(data, dtype=float)
        self.parents = parents
        self.grad: np.ndarray | None = None

    @property
    def shape(self) -> tuple[int, ...]:
        return self.data.shape

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        for v in order:
            v.grad = np.zeros_like(v.data)
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            for p, f in v.parents:
                p.grad = p.grad + f(v.grad)

    def __add__(self, o):
        o = var(o)
        return Var(self.data + o.data, [(self, lambda g: _fit(g, self.shape)), (o, lambda g: _fit(g, o.shape))])

    def __mul__(self, o):
        o = var(o)
        return Var(self.data * o.data, [(self, lambda g: _fit(g * o.data, self.shape)), (o, lambda g: _fit(g * self.data, o.shape))])

    def __truediv__(self, o):
        return self * var(o) ** -1.0

    def __pow__(self, k: float):
        return Var(self.data**k, [(self, lambda g: g * k * self.data ** (k - 1))])

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + (-var(o))

    def __rsub__(self, o):
        return var(o) - self

    def __rtruediv__(self, o):
        return var(o) / self

    __radd__, __rmul__ = __add__, __mul__

    def __matmul__(self, o):
        o = var(o)
        t = lambda x: np.swapaxes(x, -1, -2)
        return Var(self.data @ o.data, [(self, lambda g: _fit(g @ t(o.data), self.shape)), (o, lambda g: _fit(t(self.data) @ g, o.shape))])

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, at, g)
            return out

        return Var(self.data[at], [(self, back)])

    def sum(self, axis=None, keepdims=False):
        def back(g):
            return np.broadcast_to(g if axis is None or keepdims else np.expand_dims(g, axis), self.shape)

        return Var(self.data.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis=None, keepdims=False):
        n = self.data.size if axis is None else np.prod([self.shape[a] for a in np.atleast_1d(axis)])
        return self.sum(axis, keepdims) * (1.0 / n)

    def reshape(self, *shape):
        return Var(self.data.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def transpose(self, *axes):
        return Var(self.data.transpose(*axes), [(self, lambda g: g.transpose(*np.argsort(axes)))])

    def pad(self, width):
        cut = tuple(slice(a, a + n) for (a, _), n in zip(width, self.shape, strict=True))
        return Var(np.pad(self.data, width), [(self, lambda g: g[cut])])

    def clip_max(self, axis):
        m = self.data.max(axis=axis, keepdims=True)
        hit = self.data == m
        share = hit / hit.sum(axis=axis, keepdims=True)
        return Var(m.squeeze(axis), [(self, lambda g: np.expand_dims(g, axis) * share)])


def _fit(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums a broadcast gradient back to a shape."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(axis=k, keepdims=True)
    return g


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _unary(x: Var, y: np.ndarray, slope: np.ndarray) -> Var:
    return Var(y, [(x, lambda g: g * slope)])


def exp(x: Var) -> Var:
    y = np.exp(x.data)
    return _unary(x, y, y)


def log(x: Var) -> Var:
    return _unary(x, np.log(x.data), 1 / x.data)


def tanh(x: Var) -> Var:
    y = np.tanh(x.data)
    return _unary(x, y, 1 - y * y)


def sigmoid(x: Var) -> Var:
    y = 1 / (1 + np.exp(-np.clip(x.data, -60, 60)))
    return _unary(x, y, y * (1 - y))


def relu(x: Var) -> Var:
    return _unary(x, np.maximum(x.data, 0), (x.data > 0).astype(float))


def softplus(x: Var) -> Var:
    return _unary(x, np.logaddexp(0, x.data), 1 / (1 + np.exp(-np.clip(x.data, -60, 60))))


def softmax(x: Var, axis: int = -1) -> Var:
    e = exp(x - x.data.max(axis=axis, keepdims=True))
    return e / e.sum(axis, keepdims=True)


def concat(xs: Sequence[Var], axis: int = -1) -> Var:
    edge = np.cumsum([0, *(x.shape[axis] for x in xs)])

    def part(k):
        return lambda g: np.take(g, range(edge[k], edge[k + 1]), axis=axis)

    return Var(np.concatenate([x.data for x in xs], axis=axis), [(x, part(k)) for k, x in enumerate(xs)])


def stack(xs: Sequence[Var], axis: int) -> Var:
    return Var(np.stack([x.data for x in xs], axis=axis), [(x, lambda g, k=k: np.take(g, k, axis=axis)) for k, x in enumerate(xs)])


ACTIVATIONS = {"identity": lambda x: x, "relu": relu, "tanh": tanh, "sigmoid": sigmoid, "softplus": softplus}
