"""Queries on embeddings: distances, kernels, neighbours, regressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.functions import vector as X
from quern.operators import neighbors as K
from quern.operators import structures as S
from quern.plans.common import rounded, table


def _rows(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), X.doubles(F.col("embedding")).alias("x"), F.col("label").cast("double").alias("y"))


def _queries(spark, sf):
    """The stated query set: every row whose id is divisible by 50."""
    return _rows(spark, sf).where("id % 50 = 0").select(F.col("id").alias("q"), F.col("x").alias("qx"))


def _train(spark, sf):
    return _rows(spark, sf).where("id % 50 <> 0")


def _each_pair(metric):
    """Sums of a measure over all rows, for each query."""

    def run(spark, sf):
        m = K.pairs(_queries(spark, sf), _rows(spark, sf)).select("q", metric(F.col("x"), F.col("qx")).alias("m"))
        return m.groupBy("q").agg(F.count("*").alias("n"), rounded(F.min("m"), 5).alias("lo"), rounded(F.max("m"), 5).alias("hi"), rounded(F.avg("m"), 5).alias("mean"))

    return run


def _knn(classifier, weights):
    def run(spark, sf):
        out = K.KNN(7, classifier, weights=weights).fit(_train(spark, sf)).predict(_queries(spark, sf))
        return out.select("q", rounded("prediction", 5).alias("prediction"))

    return run


def _nearest(spark, sf):
    return K.nearest(_queries(spark, sf), _train(spark, sf), 5).select("q", "id", rounded("dist", 5).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


def _ball_tree(spark, sf):
    tree = S.BallTree(leaf_size=32).fit(_train(spark, sf))
    return tree.nearest(_queries(spark, sf), 5).select("q", "id", rounded("dist", 5).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


def _gp_covariance(spark, sf):
    """Posterior covariances of the query set, whose diagonal is the variance that predict() rests on."""
    gp = K.GPRegression(alpha=0.1)
    gp.fit(_rows(spark, sf).orderBy(F.xxhash64("id"), "id").limit(gp.most).select("x", "y"))
    return gp.covariance(_queries(spark, sf)).select("a", "b", rounded("cov", 9).alias("cov"))


def _gp_evidence(spark, sf):
    """Log marginal likelihoods of all rows under kernels of three widths."""
    gp = K.GPRegression(alpha=0.1)
    gp.fit(_rows(spark, sf).orderBy(F.xxhash64("id"), "id").limit(gp.most).select("x", "y"))
    wide = lambda s: lambda x, y: np.exp(-K.squared_distances(x, y) / (s * x.shape[1]))
    return spark.createDataFrame([(s, gp.evidence(wide(s))) for s in (0.5, 1.0, 2.0)], "width double, log_likelihood double")


def _queue(spark, sf):
    return S.PriorityQueue(table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry"), F.col("o_totalprice").alias("priority")))


def _queue_peek(spark, sf):
    return _queue(spark, sf).peek(50).select("entry", "priority", F.col("rank").cast("bigint").alias("rank"))


def _queue_pop(spark, sf):
    """What is first after 50 entries were taken and the customers' balances pushed."""
    out, left = _queue(spark, sf).pop(50)
    more = table(spark, sf, "customer").select((-F.col("c_custkey")).alias("entry"), (F.col("c_acctbal") * 50).alias("priority"))
    return left.push(more).peek(50).select("entry", rounded("priority", 4).alias("priority"), F.col("rank").cast("bigint").alias("rank"))


def _kernel_regression(spark, sf):
    out = K.KernelRegression(X.rbf_kernel(0.5)).fit(_train(spark, sf)).predict(_queries(spark, sf))
    return out.select("q", rounded("prediction", 5).alias("prediction"))


def _gp(spark, sf):
    """Interpolates labels of all rows. The operator's kernel matrix takes `most` training rows; where the table
    has more, those are the first by a hash of their ids."""
    gp = K.GPRegression(alpha=0.1)
    train = _rows(spark, sf).orderBy(F.xxhash64("id"), "id").limit(gp.most).select("x", "y")
    return gp.fit(train).predict(_rows(spark, sf).select(F.col("id").alias("q"), F.col("x").alias("qx")))


def _logsumexp(spark, sf):
    return _rows(spark, sf).select("id", rounded(X.logsumexp(F.col("x"))).alias("lse"))


def _density(spark, sf):
    mean, var = (F.array_repeat(F.lit(v), 64) for v in (0.0, 0.5))
    return _rows(spark, sf).select("id", rounded(X.log_gaussian_pdf(F.col("x"), mean, var)).alias("log_pdf"))


E_SQL = "e as (select vec_id as id, embedding::double[] as x, label::double as y from embeddings)"
Q_SQL = f"{E_SQL}, q as (select id as q, x as qx from e where id % 50 = 0)"
_I = "range(1, 65)"
MEASURES = {
    "euclidean": "sqrt(list_sum([pow(x[i] - qx[i], 2) for i in range(1, 65)]))",
    "manhattan": "list_sum([abs(x[i] - qx[i]) for i in range(1, 65)])",
    "chebyshev": "list_max([abs(x[i] - qx[i]) for i in range(1, 65)])",
    "minkowski": "pow(list_sum([pow(abs(x[i] - qx[i]), 3) for i in range(1, 65)]), 1.0 / 3)",
    "hamming": "list_sum([(x[i] <> qx[i])::int for i in range(1, 65)]) / 64.0::double",
    "kernel_linear": "list_sum([x[i] * qx[i] for i in range(1, 65)]) + 0.5",
    "kernel_polynomial": "pow(list_sum([x[i] * qx[i] for i in range(1, 65)]) / 64 + 1, 3)",
    "kernel_rbf": "exp(-0.5 * list_sum([pow(x[i] - qx[i], 2) for i in range(1, 65)]) / 32)",
}
METRICS = {
    "euclidean": X.euclidean, "manhattan": X.manhattan, "chebyshev": X.chebyshev, "minkowski": lambda x, y: X.minkowski(x, y, 3), "hamming": X.hamming,
    "kernel_linear": X.kernel("linear(c0=0.5)"), "kernel_polynomial": X.kernel("polynomial"), "kernel_rbf": X.kernel({"id": "RBFKernel"}),
}
_NEAR = f"""with {Q_SQL}, d as (select q, id, y, {MEASURES['euclidean']} as dist from e, q where id % 50 <> 0),
 n as (select *, row_number() over (partition by q order by dist, id) as rank from d)"""

QUERIES = {
    **{f"distance_{k}" if not k.startswith("kernel") else k: _each_pair(f) for k, f in METRICS.items()},
    "pairwise_l2": _each_pair(X.euclidean),
    "nearest_neighbors": _nearest,
    "knn_classify": _knn(True, "uniform"),
    "knn_classify_distance": _knn(True, "distance"),
    "knn_regress": _knn(False, "uniform"),
    "knn_regress_distance": _knn(False, "distance"),
    "kernel_regression": _kernel_regression,
    "gp_regression": _gp,
    "gp_covariance": _gp_covariance,
    "gp_evidence": _gp_evidence,
    "ball_tree_nearest": _ball_tree,
    "priority_queue_peek": _queue_peek,
    "priority_queue_pop": _queue_pop,
    "logsumexp": _logsumexp,
    "log_gaussian_pdf": _density,
}


def _pair_sql(measure: str) -> str:
    return f"""with {Q_SQL}, m as (select q, {measure} as m from e, q)
 select q, count(*)::bigint as n, round(min(m), 5) as lo, round(max(m), 5) as hi, round(avg(m), 5) as mean from m group by 1"""


ORACLES = {
    **{f"distance_{k}" if not k.startswith("kernel") else k: _pair_sql(m) for k, m in MEASURES.items()},
    "pairwise_l2": _pair_sql("sqrt(greatest(list_sum([x[i] * x[i] for i in range(1, 65)]) + list_sum([qx[i] * qx[i] for i in range(1, 65)]) - 2 * list_sum([x[i] * qx[i] for i in range(1, 65)]), 0))"),
    "nearest_neighbors": f"{_NEAR} select q, id, round(dist, 5) as dist, rank::bigint as rank from n where rank <= 5",
    "ball_tree_nearest": f"{_NEAR} select q, id, round(dist, 5) as dist, rank::bigint as rank from n where rank <= 5",
    "priority_queue_peek": """select entry, priority, rank::bigint as rank from (select o_orderkey as entry, o_totalprice as priority, row_number() over (order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 50""",
    "priority_queue_pop": """with o as (select o_orderkey as entry, o_totalprice as priority, row_number() over (order by o_totalprice desc, o_orderkey) as k from orders),
 p as (select entry, priority from o where k > 50 union all select -c_custkey, c_acctbal * 50 from customer), r as (select *, row_number() over (order by priority desc, entry) as rank from p)
 select entry, round(priority, 4) + 0.0 as priority, rank::bigint as rank from r where rank <= 50""",
    "knn_classify": f"{_NEAR}, v as (select q, y, count(*) as w from n where rank <= 7 group by 1, 2) select q, arg_max(y, w * 1000 - y) as prediction from v group by 1",
    "knn_classify_distance": f"{_NEAR}, v as (select q, y, sum(1 / dist) as w from n where rank <= 7 group by 1, 2) select q, y as prediction from (select *, row_number() over (partition by q order by w desc, y) as r from v) where r = 1",
    "knn_regress": f"{_NEAR} select q, round(avg(y), 5) as prediction from n where rank <= 7 group by 1",
    "knn_regress_distance": f"{_NEAR} select q, round(sum(y / dist) / sum(1 / dist), 5) as prediction from n where rank <= 7 group by 1",
    "kernel_regression": f"""with {Q_SQL}, k as (select q, y, exp(-0.5 * list_sum([pow(x[i] - qx[i], 2) for i in range(1, 65)]) / 0.25) as k from e, q where id % 50 <> 0)
 select q, round(sum(k * y) / sum(k), 5) as prediction from k group by 1""",
    "logsumexp": f"with {E_SQL} select id, round(ln(list_sum([exp(v - list_max(x)) for v in x])) + list_max(x), 6) as lse from e",
    "log_gaussian_pdf": f"with {E_SQL} select id, round(-0.5 * list_sum([v * v / 0.5 + ln(0.5) + ln(2 * pi()) for v in x]), 6) as log_pdf from e",
}
