"""Distances, kernels and densities of array columns."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it within lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b))))


def manhattan(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def chebyshev(x: Column, y: Column) -> Column:
    return F.array_max(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def minkowski(x: Column, y: Column, p: float) -> Column:
    return F.pow(_sum(F.zip_with(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p))))), F.lit(1.0 / p))


def hamming(x: Column, y: Column) -> Column:
    """The share of places that differ."""
    return _sum(F.zip_with(x, y, lambda a, b: (a != b).cast("double"))) / F.size(x)


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "manhattan": manhattan, "chebyshev": chebyshev, "hamming": hamming}


def linear_kernel(c0: float = 0.0):
    return lambda x, y: dot(x, y) + c0


def polynomial_kernel(d: float = 3, gamma: float | None = None, c0: float = 1.0):
    return lambda x, y: F.pow((dot(x, y) * gamma if gamma is not None else dot(x, y) / F.size(x)) + c0, F.lit(float(d)))


def rbf_kernel(sigma: float | None = None):
    """exp(-|x - y|^2 / (2 sigma^2)); sigma is sqrt(M / 2) unless given."""

    def kernel(x: Column, y: Column) -> Column:
        square = _sum(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))
        return F.exp(-0.5 * square / (F.size(x) / 2.0 if sigma is None else F.lit(sigma * sigma)))

    return kernel


KERNELS = {"linear": linear_kernel, "polynomial": polynomial_kernel, "rbf": rbf_kernel}


def kernel(spec: str | dict | Callable | None = None):
    """A kernel from nothing (linear), a name with arguments such as "rbf(sigma=2)", a mapping, or itself."""
    if spec is None:
        return linear_kernel()
    if callable(spec):
        return spec
    if isinstance(spec, dict):
        return KERNELS[spec["id"].lower().removesuffix("kernel")](**spec.get("hyperparameters", {}))
    call = ast.parse(spec if "(" in spec else f"{spec}()", mode="eval").body
    if not isinstance(call, ast.Call) or not isinstance(call.func, ast.Name) or call.args:
        raise ValueError(f"not a kernel: {spec}")
    return KERNELS[call.func.id.lower().removesuffix("kernel")](**{k.arg: ast.literal_eval(k.value) for k in call.keywords})


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda top: F.log(_sum(F.transform(a, lambda x: F.exp(x - top)))) + top)


def softmax(a: Column) -> Column:
    e = let(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top)))
    return let(e, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def log_gaussian_pdf(x: Column, mean: Column, variance: Column) -> Column:
    """Log density of a normal distribution with a diagonal covariance."""
    terms = F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), variance, lambda s, v: s / v + F.log(v) + math.log(2 * math.pi))
    return -0.5 * _sum(terms)
