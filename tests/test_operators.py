import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import autodiff as A
from quern.operators import features as E
from quern.operators import graph as G
from quern.operators import latent as L
from quern.operators import linear as LM
from quern.operators import networks as N
from quern.operators import neighbors as K
from quern.operators import structures as S
from quern.operators import trees as T
from quern.operators import vocabulary as V
from quern.operators.joins import join_single


def test_huffman_codes_are_prefix_free_and_short():
    counts = [("a", 50), ("b", 20), ("c", 20), ("d", 9), ("e", 1)]
    codes = V.huffman_codes(counts)
    assert not any(x != y and y.startswith(x) for x in codes.values() for y in codes.values())
    assert sum(n * len(codes[s]) for s, n in counts) == 50 + 2 * 20 + 3 * 20 + 4 * 10
    assert V.huffman_codes([("a", 3)]) == {"a": "0"} and V.huffman_codes([]) == {}


def test_huffman_unknown_symbol_raises(spark):
    m = V.HuffmanEncoder.fit(spark.createDataFrame([("a",), ("b",)], "token string"))
    with pytest.raises(Exception, match="no code"):
        m.transform(spark.createDataFrame([("z",)], "token string")).collect()


def test_standardizer_needs_rows_and_knows_no_spread(spark):
    with pytest.raises(ValueError):
        E.Standardizer(["x"]).fit(spark.createDataFrame([(1.0,)], "x double"))
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r["x"] for r in E.Standardizer(["x"]).fit(df).transform(df).collect()] == [None, None]


def test_one_hot_unknown_label_raises(spark):
    enc = E.OneHotEncoder(["a", "b"])
    with pytest.raises(Exception, match="unknown label"):
        spark.range(1).select(enc.transform(F.lit("c"))).collect()


def test_cycle_has_no_order(spark):
    v = spark.range(3)
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0)], "src bigint, dst bigint, w double")
    g = G.Graph(v, e)
    assert not g.is_acyclic() and g.topological_ordering() is None and g.path_exists(0, 2)
    assert sorted(r["path"] for r in g.all_paths(0, 2).collect()) == [[0, 1, 2]]


def test_knn_with_a_neighbour_at_no_distance(spark):
    train = spark.createDataFrame([(1, [0.0], 5.0), (2, [1.0], 9.0), (3, [1.1], 9.0)], "id long, x array<double>, y double")
    q = spark.createDataFrame([(7, [0.0])], "q long, qx array<double>")
    assert K.KNN(3, True, weights="distance").fit(train).predict(q).first()["prediction"] == 5.0
    assert K.KNN(3, True).fit(train).predict(q).first()["prediction"] == 9.0


def test_gp_interpolates(spark):
    train = spark.createDataFrame([([float(i)], float(i * i)) for i in range(5)], "x array<double>, y double")
    m = K.GPRegression().fit(train)
    out = m.predict(spark.createDataFrame([(i, [float(i)]) for i in range(5)], "q long, qx array<double>")).collect()
    assert all(r["mean"] == pytest.approx(r["q"] ** 2, abs=1e-3) and r["half_width"] < 1e-2 for r in out)
    assert np.isfinite(m.marginal_log_likelihood()) and m.sample(np.array([[0.5]]), 3).shape == (3, 1)


def test_tree_separates_classes_and_deeper_is_no_worse(spark):
    rows = [(float(i), float(i % 3), "a" if (i < 5) != (i % 3 == 1) else "b") for i in range(30)]
    df = spark.createDataFrame(rows, "x double, z double, y string")
    errors = []
    for depth in (1, 3):
        t = T.DecisionTree(["x", "z"], "y", ["a", "b"], depth).fit(df)
        errors.append(t.predict(df).where("y <> prediction").count())
    assert errors[1] == 0 < errors[0]


def test_boosting_lowers_the_error(spark):
    df = spark.createDataFrame([(float(i), float((i % 7) ** 2)) for i in range(70)], "x double, y double").withColumn("z", F.col("x") % 7)
    mse = [T.GradientBoostedDecisionTree(["x", "z"], "y", n_iter=n).fit(df).predict(df).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0] for n in (1, 4)]
    assert mse[1] < mse[0]


def test_logistic_penalty_shrinks(spark):
    df = spark.createDataFrame([(float(i), float(i > 5)) for i in range(10)], "x double, y double").withColumn("x", F.col("x") / 10)
    loose, tight = (LM.LogisticRegression(["x"], "y", gamma=g).fit(df, lr=1.0, max_iter=40).beta for g in (0.0, 5.0))
    assert abs(tight[1]) < abs(loose[1])


def test_regression_in_parts_equals_regression_at_once(spark):
    df = spark.createDataFrame([(float(i), float(i % 4), 3.0 * i - i % 4 + 1) for i in range(40)], "a double, b double, y double")
    whole = LM.LinearRegression(["a", "b"], ["y"]).fit(df).beta
    parts = LM.LinearRegression(["a", "b"], ["y"]).fit(df.where("a < 10")).update(df.where("a >= 10")).beta
    assert np.allclose(whole, parts) and np.allclose(whole[:, 0], [1, 3, -1])


def test_gmm_finds_two_clusters(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.3, (60, 2)), rng.normal(5, 0.3, (60, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    m = L.GMM(2).fit(df, 20)
    own = [r["component"] for r in m.predict(df).orderBy("id").collect()]
    assert len(set(own[:60])) == 1 and len(set(own[60:])) == 1 and own[0] != own[-1]
    assert all(b >= a - 1e-6 for a, b in zip(m.bounds, m.bounds[1:], strict=False))


def test_digamma():
    assert np.allclose(L.digamma(np.array([1.0, 0.5, 10.0])), [-0.5772156649, -1.9635100260, 2.2517525890])


def test_networks_gradients():
    rng = np.random.default_rng(3)
    params = N.recurrent_params(rng, "l.fwd", 2, 2, 4) | N.recurrent_params(rng, "l.bwd", 2, 2, 4) | {"c.w": rng.normal(size=(2, 2, 1, 1)), "c.b": np.zeros(1)}
    params |= {k: v for s in "qkvo" for k, v in N.dense_params(rng, f"a.{s}", 4, 4).items()}
    x = rng.normal(size=(2, 3, 2))
    img = rng.normal(size=(1, 3, 3, 1))

    def f(p):
        h = N.bidirectional_lstm(p, "l", A.Var(x))
        y = N.multi_head(p, "a", h, h, h, 2)
        d = N.deconv2d(p, "c", A.Var(img), 2)
        return (y * y).sum() + (d * d).sum() + N.pool2d(N.conv2d(p, "c", A.Var(img)), 2, 1).sum()

    p = {k: A.Var(v) for k, v in params.items()}
    f(p).backward()
    for k, v in params.items():
        at = tuple(0 for _ in v.shape)
        up, down = ({n: A.Var(m.copy()) for n, m in params.items()} for _ in range(2))
        up[k].data[at] += 1e-5
        down[k].data[at] -= 1e-5
        assert (f(up).data - f(down).data) / 2e-5 == pytest.approx(p[k].grad[at], abs=1e-4), k


def test_deconvolution_places_the_kernel():
    w = np.arange(9.0).reshape(3, 3, 1, 1)
    x = np.zeros((1, 2, 2, 1))
    x[0, 1, 0, 0] = 1
    out = N.deconv2d({"c.w": A.Var(w), "c.b": A.Var(np.zeros(1))}, "c", A.Var(x), 2).data[0, :, :, 0]
    assert out.shape == (5, 5) and np.allclose(out[2:5, 0:3], w[:, :, 0, 0]) and out.sum() == w.sum()


def test_baum_welch_reads_whole_sequences(spark):
    from conftest import SF

    from quern.plans import latent

    e = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    kinds = sorted({r["event_type"] for r in e})
    a, b, pi = latent.HMM.a, latent.HMM.b, latent.HMM.pi
    want = 0.0
    for user in {r["user_id"] for r in e}:
        f = pi
        for k, r in enumerate(r for r in e if r["user_id"] == user):
            f = (f @ a if k else f) * b[:, kinds.index(r["event_type"])]
            want, f = want + np.log(f.sum()), f / f.sum()
    got = {r["round"]: r["log_likelihood"] for r in latent.QUERIES["hmm_baum_welch"](spark, SF).collect()}
    assert abs(got[0] - want) < 1e-9 * abs(want)


def test_ball_tree_finds_what_all_pairs_find(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) + 5 * (i % 4)).tolist(), 0.0) for i in range(400)] + [(400 + i, [1.0, 1.0, 1.0], 0.0) for i in range(20)] + [(500, None, 0.0)]
    train = spark.createDataFrame(rows, "id long, x array<double>, y double")
    queries = spark.createDataFrame([(i, (rng.normal(size=3) * 8).tolist()) for i in range(15)] + [(99, [1.0, 1.0, 1.0]), (100, None)], "q long, qx array<double>")
    for args, k in (({"leaf_size": 16}, 7), ({"leaf_size": 10_000}, 3), ({"leaf_size": 1, "most_leaves": 64}, 500)):
        got = S.BallTree(**args).fit(train).nearest(queries, k)
        want = K.nearest(queries.where("qx is not null"), train.where("x is not null"), k)
        rounded = lambda d: sorted((r["q"], r["rank"], r["id"], round(r["dist"], 9)) for r in d.collect())
        assert rounded(got) == rounded(want)
    assert S.BallTree().fit(train.limit(0)).nearest(queries, 2).count() == 0


def test_priority_queue(spark):
    q = S.PriorityQueue(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (3, 9.0), (4, None)], "entry long, priority double"))
    out, rest = q.pop(1)
    assert [(r["entry"], r["rank"]) for r in out.collect()] == [(3, 1)]
    assert [r["entry"] for r in rest.peek(9).orderBy("rank").collect()] == [3, 1, 2]
    small = S.PriorityQueue(q.entries.limit(0), False, 2).push(q.entries.where("priority is not null"))
    assert [r["entry"] for r in small.peek(9).orderBy("rank").collect()] == [1, 2]
    assert q.peek(0).count() == 0


def test_gp_covariance_and_evidence(spark):
    train = spark.createDataFrame([([float(i)], float(i * i)) for i in range(5)], "x array<double>, y double")
    m = K.GPRegression(alpha=0.01).fit(train)
    q = spark.createDataFrame([(1, [0.5]), (2, [7.0])], "q long, qx array<double>")
    cov = {(r["a"], r["b"]): r["cov"] for r in m.covariance(q).collect()}
    width = {r["q"]: r["half_width"] for r in m.predict(q).collect()}
    assert cov[1, 2] == pytest.approx(cov[2, 1]) and all(width[k] == pytest.approx(1.959964 * cov[k, k] ** 0.5, rel=1e-5) for k in (1, 2))
    assert m.evidence(m.kernel) == pytest.approx(m.marginal_log_likelihood())


def test_single_rows_are_shuffled_for_the_join(spark):
    rows = spark.createDataFrame([("a", k) for k in range(500)] + [("b", 1), ("c", 2), (None, 3)], "key string, x long")
    single = rows.where("key is not null and key <> 'c'").groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = join_single(rows, single, "key", how)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(single, "key", how).collect()))
