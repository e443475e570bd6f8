"""Signals as array columns of doubles: frames, transforms, windows, mel scale. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.vector import dot, let

EPS = 2.220446049250313e-16


def _range(n: Column | int, start: int = 0) -> Column:
    """start .. n - 1; n is at least start + 1."""
    return F.sequence(F.lit(start), (n if isinstance(n, Column) else F.lit(n)) - 1)


def to_frames(x: Column, width: int, stride: int) -> Column:
    """Overlapping frames, (length - width) / stride + 1 of them; none where the signal is shorter."""
    n = F.floor((F.size(x) - width) / stride).cast("int")
    frames = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.slice(x, i * stride + 1, width))
    return F.when(F.size(x) >= width, frames).otherwise(F.array().cast("array<array<double>>"))


def preemphasis(x: Column, alpha: float) -> Column:
    """x[0], then x[t] - alpha x[t-1]."""
    return F.zip_with(x, F.concat(F.array(F.lit(0.0)), F.slice(x, 1, F.size(x) - 1)), lambda a, b: a - alpha * b)


def autocorrelate(x: Column) -> Column:
    """At lag k, the sum of x[n + k] x[n]."""
    product = lambda x, k: F.zip_with(F.slice(x, k + 1, F.size(x) - k), F.slice(x, 1, F.size(x) - k), lambda a, b: a * b)
    return let(x, lambda x: F.transform(_range(F.size(x)), lambda k: F.aggregate(product(x, k), F.lit(0.0), lambda s, v: s + v)))


def _weighted(x: Column, weight) -> Column:
    return F.aggregate(F.transform(x, lambda v, n: v * weight(n)), F.lit(0.0), lambda s, v: s + v)


def dct(x: Column, orthonormal: bool = True) -> Column:
    """DCT-II: 2 sum x[n] cos(pi k (2n + 1) / 2N), scaled to be orthonormal if asked for."""

    def coefficient(x: Column, k: Column) -> Column:
        n = F.size(x)
        c = 2.0 * _weighted(x, lambda i: F.cos(math.pi * k * (2 * i + 1) / (2 * n)))
        return c * F.when(k == 0, F.sqrt(1.0 / (4.0 * n))).otherwise(F.sqrt(1.0 / (2.0 * n))) if orthonormal else c

    return let(x, lambda x: F.transform(_range(F.size(x)), lambda k: coefficient(x, k)))


def dft(x: Column, positive_only: bool = True) -> Column:
    """Structs (re, im) of sum x[n] exp(-2 pi i k n / N); the first N / 2 + 1 of them or all."""

    def all_bins(x: Column) -> Column:
        n = F.size(x)
        angle = lambda k, i: -2 * math.pi * k * i / n
        count = F.floor(n / 2).cast("int") + 1 if positive_only else n
        return F.transform(_range(count), lambda k: F.struct(_weighted(x, lambda i: F.cos(angle(k, i))).alias("re"), _weighted(x, lambda i: F.sin(angle(k, i))).alias("im")))

    return let(x, all_bins)


def dft_bins(n: int, fs: float = 44_000, positive_only: bool = True) -> Column:
    """Frequencies of the bins; negative ones follow where all are asked for."""
    half = n // 2
    if positive_only:
        return F.transform(_range(half + 1), lambda k: k * fs / n)
    return F.transform(_range(n), lambda k: F.when(k < (n + 1) // 2, k).otherwise(k - n) * fs / n)


def magnitude(spectrum: Column) -> Column:
    return F.transform(spectrum, lambda c: F.sqrt(c["re"] * c["re"] + c["im"] * c["im"]))


def power(spectrum: Column, scale: bool = False) -> Column:
    return let(spectrum, lambda s: F.transform(s, lambda c: (c["re"] * c["re"] + c["im"] * c["im"]) / (F.size(s) if scale else F.lit(1.0))))


#: Coefficients of generalized cosine windows.
WINDOWS = {"hamming": (0.54, 0.46), "hann": (0.5, 0.5), "blackman_harris": (0.35875, 0.48829, 0.14128, 0.01168)}


def generalized_cosine(n: int, coefficients: tuple[float, ...], symmetric: bool = False) -> Column:
    """sum (-1)^k a_k cos(k t) at n points from 0 to 2 pi; a periodic window leaves the last point out."""
    span = max(n - 1 if symmetric else n, 1)
    return F.transform(_range(n), lambda i: sum(((-1) ** k * a * F.cos(2 * math.pi * k * i / span) for k, a in enumerate(coefficients)), F.lit(0.0)))


def window(name: str, n: int, symmetric: bool = False) -> Column:
    return generalized_cosine(n, WINDOWS[name], symmetric)


def cepstral_lifter(c: Column, d: int) -> Column:
    return F.transform(c, lambda v, n: v * (1 + d / 2 * F.sin(math.pi * n / d))) if d else c


def hz2mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def mel2hz(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def mel_filterbank(n: int, n_filters: int = 20, fs: float = 44_000, lo: float = 0.0, hi: float | None = None, normalize: bool = True) -> list[list[float]]:
    """Triangular filters over the first n / 2 + 1 bins, of equal area if normalized. A small constant table."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    a, b = mel(lo), mel(fs / 2 if hi is None else hi)
    edge = [700 * (10 ** ((a + (b - a) * i / (n_filters + 1)) / 2595) - 1) for i in range(n_filters + 2)]
    bins = [k * fs / n for k in range(n // 2 + 1)]
    out = []
    for left, mid, right in zip(edge, edge[1:], edge[2:], strict=False):
        row = [max(0.0, min((f - left) / (mid - left), (right - f) / (right - mid))) for f in bins]
        out.append([v * 2 / (right - left) for v in row] if normalize else row)
    return out


def _literal(rows: list[list[float]]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def mel_energies(frame: Column, width: int, n_filters: int, fs: float, window_name: str) -> Column:
    """Mel energies of one frame of the given width; zero energies become machine epsilon."""
    spectrum = power(dft(F.zip_with(frame, window(window_name, width), lambda a, b: a * b)), scale=True)
    filters = _literal(mel_filterbank(width, n_filters, fs))
    return let(spectrum, lambda s: F.transform(filters, lambda f: F.greatest(dot(f, s), F.lit(EPS))))


def mfcc(energies: Column, n: int = 13, lifter: int = 22) -> Column:
    """Cepstral coefficients of mel energies, without the mean subtracted."""
    return cepstral_lifter(F.slice(dct(F.transform(energies, lambda e: 10 * F.log10(e))), 1, n), lifter)


def nearest_1d(x: Column, t: Column) -> Column:
    """The sample nearest to t, clipped to the signal; halves go to the even place."""
    return F.element_at(x, (F.least(F.greatest(F.bround(t), F.lit(0)), F.size(x) - 1) + 1).cast("int"))


def bilinear_1d_weights(t: Column, n: Column) -> tuple[Column, Column, Column]:
    """Left place, right place and the right one's weight for a coordinate clipped to 0 .. n - 1."""
    c = F.least(F.greatest(t, F.lit(0.0)), (n - 1).cast("double"))
    left = F.least(F.floor(c), n - 2).cast("int")
    return left, left + 1, c - left
