import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import autodiff as A
from quern.functions import neural as N
from quern.functions import signal as S
from quern.functions import text as T
from quern.functions import vector as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    lit = F.lit("Hello, wide WORLD... naïve_x a")
    assert one(spark, T.tokenize_words(lit, stop=None)) == ["hello", "wide", "world", "naïve_x"]
    assert one(spark, T.strip_punctuation(F.lit(" a.b, "))) == "ab"
    assert one(spark, T.bytes_to_chars(T.utf8_bytes(F.lit("é€")))) == "é€"
    assert one(spark, T.ngrams(F.array(F.lit("a")), 2)) == []
    assert one(spark, T.tokenize_bytes_raw(F.lit("a,b"), split_punctuation=True)) == ["97", "44", "98"]


@pytest.mark.parametrize("name", sorted(N.ACTIVATIONS))
def test_activation_derivatives(spark, name):
    a, h = N.ACTIVATIONS[name], 1e-4
    z = spark.createDataFrame([(v,) for v in (-3.1, -1.3, -0.4, 0.3, 1.7)], "z double")
    c = F.col("z")
    for r in z.select(((a.fn(c + h) - a.fn(c - h)) / (2 * h)).alias("n"), a.grad(c).alias("g"), ((a.grad(c + h) - a.grad(c - h)) / (2 * h)).alias("n2"), a.grad2(c).alias("g2")).collect():
        tol = 2e-3 if name == "gelu_exact" else 1e-5
        assert r["n"] == pytest.approx(r["g"], abs=tol)
        assert r["n2"] == pytest.approx(r["g2"], abs=tol)


def test_transforms_against_numpy(spark):
    x = [0.5, -1.0, 2.0, 3.5, -0.25, 1.0]
    col = F.array(*map(F.lit, x))
    got = one(spark, S.dft(col))
    want = np.fft.rfft(x)
    assert np.allclose([r["re"] for r in got], want.real) and np.allclose([r["im"] for r in got], want.imag)
    assert np.allclose(one(spark, S.autocorrelate(col)), np.correlate(x, x, "full")[len(x) - 1 :])
    assert np.allclose(one(spark, S.dft_bins(6, 10.0, False)), np.fft.fftfreq(6, 0.1))
    assert one(spark, S.to_frames(col, 10, 2)) == []


def test_kernel_specs():
    assert X.kernel("rbf(sigma=2.0)") and X.kernel(None) and X.kernel({"id": "PolynomialKernel", "hyperparameters": {"d": 2}})
    for bad in ("__import__('os')", "rbf(1)", "rbf(sigma=open('x'))"):
        with pytest.raises((ValueError, KeyError)):
            X.kernel(bad)


def test_autodiff_matches_differences():
    rng = np.random.default_rng(0)
    w = {k: rng.normal(size=s) for k, s in {"a": (4, 3), "b": (3,), "c": (3, 2)}.items()}
    x = rng.normal(size=(5, 4))

    def f(p):
        h = A.tanh(A.Var(x) @ p["a"] + p["b"])
        y = A.softmax(h @ p["c"]) * A.sigmoid(h @ p["c"])
        return (A.log(y + 1.0) / (A.exp(y) + 2.0)).sum() + A.relu(h)[1:3].mean() + A.concat([h, h], 1).reshape(-1)[::2].sum() + A.softplus(h).clip_max(1).sum()

    p = {k: A.Var(v) for k, v in w.items()}
    f(p).backward()
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            up, down = ({n: A.Var(m.copy()) for n, m in w.items()} for _ in range(2))
            up[k].data[at] += 1e-6
            down[k].data[at] -= 1e-6
            assert (f(up).data - f(down).data) / 2e-6 == pytest.approx(p[k].grad[at], abs=1e-5)


def test_king_scheduler_waits():
    k = N.KingScheduler(lr=1.0, patience=4, decay=0.5)
    assert all(k(1.0 / (i + 1)) == 1.0 for i in range(10))
    assert min(k(1.0 + 0.1 * i) for i in range(20)) < 1.0
    assert math.isclose(N.falling_probability(np.array([3, 2, 1, 0.0])), 1.0)


@pytest.mark.parametrize("patience", [4, 10, 50, 1000])
def test_king_scheduler_decays_on_a_plateau_alone(patience):
    rising, falling = N.KingScheduler(1.0, patience), N.KingScheduler(1.0, patience)
    for k in range(2 * patience + 10):
        rising(1.0 + 0.01 * k)
        falling(1.0 / (1 + k))
    assert rising.lr < 1.0 and falling.lr == 1.0
    spiky = N.KingScheduler(1.0, patience)
    for k in range(2 * patience + 10):  # transient spikes among falling losses
        spiky(10.0 - 4.0 * k / patience + (50.0 if k % 25 == 24 else 0.0))
    assert spiky.lr == 1.0


def test_probability_of_a_falling_line_against_least_squares():
    rng = np.random.default_rng(0)
    for n in (3, 10, 200):
        y = rng.normal(size=n) - 0.01 * np.arange(n)
        x = np.c_[np.ones(n), np.arange(n)]
        beta, rest, *_ = np.linalg.lstsq(x, y, rcond=None)
        sd = math.sqrt(rest[0] / (n - 2) * np.linalg.inv(x.T @ x)[1, 1])
        assert N.falling_probability(y) == pytest.approx(0.5 * (1 + math.erf(-beta[1] / sd / math.sqrt(2))))
