"""What larger tables and odd rows have shown."""

import tracemalloc

import duckdb
import numpy as np

from quern.llm import kneser_ney as KN
from quern.llm.components import connected_components
from quern.operators import latent as L
from quern.operators import neighbors as K
from quern.plans import decision


def test_greedy_arm_needs_no_equal_sums(spark, tmp_path):
    duckdb.sql(
        """select k as event_id, timestamp '2024-01-01' + interval (k) second as ts, if(k % 4 = 3, null, k % 4) as user_id,
        'arm' || (k // 4 % 3) as event_type, if(k % 4 = 2, null, (k * 7919 % 10007) / 100.0::double) as value from range(1200) t(k)"""
    ).write_parquet(f"{tmp_path}/events.parquet")
    df = decision._greedy(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(con.execute(decision.ORACLES["bandit_greedy"]).fetchall(), key=str)
    # a join by sums of doubles loses users where tasks add up in another order
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_gp_predicts_many_rows_in_small_blocks(spark):
    sizes = []

    def kernel(x, y):
        sizes.append(len(x))
        assert len(x) <= 512
        return K.GPRegression.rbf(x, y)

    rng = np.random.default_rng(3)
    train = spark.createDataFrame([(v.tolist(), float(v[0])) for v in rng.normal(size=(300, 4))], "x array<double>, y double")
    m = K.GPRegression(kernel, alpha=0.1).fit(train)
    x = rng.normal(size=(1300, 4))
    got = {r["q"]: r for r in m.predict(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "q long, qx array<double>").coalesce(1)).collect()}
    k = np.exp(-((x[:, None] - m.x[None]) ** 2).sum(-1) / 4)
    var = 1 - np.einsum("ij,jk,ik->i", k, np.linalg.inv(m.l @ m.l.T), k)
    assert len(got) == 1300 and np.allclose([got[q]["mean"] for q in range(1300)], k @ m.a)
    assert np.allclose([got[q]["half_width"] for q in range(1300)], 1.959963984540054 * np.sqrt(var))


def test_distances_hold_few_differences():
    x, y = np.random.default_rng(0).normal(size=(2, 1000, 64))
    tracemalloc.start()
    d = K.squared_distances(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6 and np.array_equal(d[::100], ((x[::100, None] - y[None]) ** 2).sum(-1))
    assert K.squared_distances(x[:0], y).shape == (0, 1000) and K.squared_distances(x, y[:0]).shape == (1000, 0)


def test_gp_covariance_takes_any_number_of_queries(spark):
    rng = np.random.default_rng(5)
    train = spark.createDataFrame([(v.tolist(), float(v[0])) for v in rng.normal(size=(40, 3))], "x array<double>, y double")
    m = K.GPRegression(alpha=0.1, most=40, block=32).fit(train)
    x = rng.normal(size=(130, 3))
    rows = m.covariance(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "q long, qx array<double>")).collect()
    got = {(r["a"], r["b"]): r["cov"] for r in rows}
    k = m.rbf(x, m.x)
    cov = m.rbf(x, x) - k @ np.linalg.inv(m.l @ m.l.T) @ k.T
    assert len(rows) == len(got) == 130 * 130
    assert np.allclose([[got[a, b] for b in range(130)] for a in range(130)], cov)
    assert not m.covariance(spark.createDataFrame([], "q long, qx array<double>")).collect()


def test_few_edges_are_labelled_without_rounds(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k + 1000, k + 1001) for k in range(150)] + [(2000, 3000 + k) for k in range(200)] + [(5, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    group = spark.sparkContext.statusTracker()
    jobs = []
    for few in (0, 500_000):
        spark.sparkContext.setJobGroup(f"few-{few}", "components")
        jobs.append((sorted(map(tuple, connected_components(df, few=few).collect())), len(group.getJobIdsForGroup(f"few-{few}"))))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0][0] == jobs[1][0] and jobs[1][1] < jobs[0][1] / 2
    assert not connected_components(df.limit(0)).collect()


def _plain_lda(docs, t, v, seed, rounds, inner=20):
    """One document at a time; the bounds of the rounds."""
    m = L.LDA(t, v, seed, np.full(t, 1.0))
    beta = L.Topics.drawn(np.arange(v), t, seed)
    beta, bounds = beta / beta.sum(1, keepdims=True), []
    for _ in range(rounds):
        bound, dg, stats = 0.0, np.zeros(t), np.full((t, v), 1e-9)
        for words in filter(len, docs):
            w, n = np.unique(words, return_counts=True)
            gamma = m.alpha + n.sum() / t
            for _ in range(inner):
                phi = beta[:, w] * np.exp(L.digamma(gamma) - L.digamma(gamma.sum(keepdims=True)))[:, None] + 1e-100
                phi /= phi.sum(0)
                gamma = m.alpha + phi @ n
            e = L.digamma(gamma) - L.digamma(gamma.sum(keepdims=True))
            bound += L.lgamma(m.alpha.sum()) - L.lgamma(m.alpha).sum() + ((m.alpha - gamma) * e).sum() + L.lgamma(gamma).sum() - L.lgamma(gamma.sum())
            bound += (n * (phi * (e[:, None] + np.log(beta[:, w] + 1e-100) - np.log(phi)))).sum()
            dg += e
            stats[:, w] += phi * n
        bounds.append(float(bound))
        beta = stats / stats.sum(1, keepdims=True)
        m._newton(dg, sum(map(bool, docs)))
    return bounds, beta


def test_topics_stay_with_the_workers(spark, monkeypatch):
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 60, rng.integers(0, 40)).tolist() for _ in range(90)] + [[]]
    df = spark.createDataFrame([(d,) for d in docs], "words array<int>").repartition(3)
    bounds, beta = _plain_lda(docs, 3, 61, 0, 4)
    for small in (False, True):
        if small:  # the workers' own copies stay as they are; the driver's rows are a few for each file
            monkeypatch.setattr(L, "_mounted", lambda _: None)
        m = L.LDA(3, 61).train(df, max_iter=4, tol=0)
        assert np.allclose(m.bounds, bounds) and np.allclose(m.topics.of(np.arange(61)), beta)
        assert (m.topics.dense is None) != small


def test_driver_gets_no_row_for_each_word(spark, monkeypatch):
    got = []
    frame = type(spark.range(1))
    plain = frame.toPandas
    monkeypatch.setattr(frame, "toPandas", lambda self: got.append(plain(self)) or got[-1])
    df = spark.createDataFrame([([k, k + 1],) for k in range(2000)], "words array<int>")
    L.LDA(3, 2001).train(df, max_iter=2, tol=0)
    assert got and all(len(x) < 10 for x in got)


def test_rows_of_few_bits_are_sorted_once(monkeypatch):
    rng = np.random.default_rng(1)
    columns = [rng.integers(0, 21, 5000).astype(np.uint32) for _ in range(3)]
    plain, n = KN._distinct(columns)
    sorts, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **b: sorts.append(1) or unique(*a, **b))
    got, m = KN._distinct(columns, bits=5)
    assert len(sorts) == 1 and np.array_equal(n, m) and all(np.array_equal(x, y) and y.dtype == np.uint32 for x, y in zip(plain, got, strict=True))
