"""Linear models of line items and orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.operators import linear as L
from quern.plans.common import rounded, table

#: Columns of line items that models use: quantity, discount, tax, price in thousands, whether returned.
ITEMS_SQL = """li as (select l_orderkey, l_linenumber, l_quantity as q, l_discount as d, l_tax as t, l_extendedprice / 1000 as y,
 (l_returnflag = 'R')::int::double as r, l_returnflag as flag from lineitem)"""


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("r"), F.col("l_returnflag").alias("flag"),
    )


def _coefficients(spark, names, values):
    return spark.createDataFrame([(n, round(float(v), 6) + 0.0) for n, v in zip(names, values, strict=True)], "term string, value double")


def _ols_simple(spark, sf):
    m = L.LinearRegression(["q"], ["y"]).fit(_items(spark, sf))
    return _coefficients(spark, ["intercept", "q"], m.beta[:, 0])


def _ols_weighted(spark, sf):
    m = L.LinearRegression(["q"], ["y"]).fit(_items(spark, sf).withColumn("w", 1 + F.col("d")), "w")
    return _coefficients(spark, ["intercept", "q"], m.beta[:, 0])


def _ols_update(spark, sf):
    """Half of the rows, then the other half: the same as all at once."""
    rows = _items(spark, sf)
    m = L.LinearRegression(["q"], ["y"]).fit(rows.where("l_linenumber % 2 = 0")).update(rows.where("l_linenumber % 2 = 1"))
    return _coefficients(spark, ["intercept", "q"], m.beta[:, 0])


def _ols_multi_sums(spark, sf):
    s = L.sums(_items(spark, sf), L.terms(["q", "d", "t"]), [F.col("y")])
    names = ["1", "q", "d", "t"]
    rows = [(f"{a}*{b}", round(float(s.xx[i, j]), 5)) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    rows += [(f"{a}*y", round(float(s.xy[i, 0]), 5)) for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "term string, value double")


def _ols_multi_predict(spark, sf):
    """Residuals of a fit with an intercept sum to 0 and are orthogonal to the features."""
    m = L.LinearRegression(["q", "d", "t"], ["y", "r"]).fit(_items(spark, sf))
    e = m.predict(_items(spark, sf)).withColumn("e", F.col("y") - F.col("y_hat"))
    return e.agg(F.count("*").alias("n"), rounded(F.sum("e"), 2).alias("sum_e"), rounded(F.sum(F.col("e") * F.col("d")), 2).alias("sum_ed"), rounded(F.avg("r_hat"), 6).alias("mean_r"))


def _ridge(spark, sf):
    m = L.RidgeRegression(["q"], ["y"], alpha=100.0).fit(_items(spark, sf))
    return _coefficients(spark, ["intercept", "q"], m.beta[:, 0])


def _ridge_predict(spark, sf):
    m = L.RidgeRegression(["q"], ["y"], alpha=100.0).fit(_items(spark, sf))
    return m.predict(_items(spark, sf)).groupBy("flag").agg(rounded(F.avg("y_hat"), 5).alias("mean"))


def _logistic_step(spark, sf):
    loss, g = L.LogisticRegression(["q", "d"], "r", gamma=2.0).loss_and_gradient(_items(spark, sf), _BETA)
    return _coefficients(spark, ["loss", "intercept", "q", "d"], [loss, *g])


def _logistic_fit(spark, sf):
    rows = _items(spark, sf).withColumn("q", F.col("q") / 50).persist()
    m = L.LogisticRegression(["q", "d"], "r").fit(rows, lr=1.0, max_iter=15)
    return spark.createDataFrame([(k, float(v), all(a >= b for a, b in zip(m.losses, m.losses[1:], strict=False))) for k, v in enumerate(m.beta)], "term int, value double, falls boolean")


def _logistic_predict(spark, sf):
    m = L.LogisticRegression(["q", "d"], "r")
    m.beta = _BETA
    return m.predict(_items(spark, sf)).groupBy("flag").agg(rounded(F.avg("probability")).alias("p"))


def _glm_step(link):
    def run(spark, sf):
        target = "r" if link == "logit" else "y"
        b = L.GeneralizedLinearModel(["d"], target, link).step(_items(spark, sf), _START[link])
        return _coefficients(spark, ["intercept", "d"], b)

    return run


def _glm_fit(spark, sf):
    rows = _items(spark, sf).persist()
    out = [(link, k, float(v)) for link, y in (("logit", "r"), ("log", "y"), ("identity", "y")) for k, v in enumerate(L.GeneralizedLinearModel(["d"], y, link).fit(rows).beta)]
    return spark.createDataFrame(out, "link string, term int, value double")


def _nb_fit(spark, sf):
    m = L.GaussianNBClassifier(["q", "d", "y"], "flag").fit(_items(spark, sf))
    return m.stats.select("_label", "_n", rounded("prior").alias("prior"), *(rounded(f"{f}_{k}").alias(f"{f}_{k}") for f in "qdy" for k in ("mean", "var")))


def _nb_predict(spark, sf):
    rows = _items(spark, sf)
    return L.GaussianNBClassifier(["q", "d", "y"], "flag").fit(rows).predict(rows).groupBy("flag", "prediction").agg(F.count("*").alias("n"))


def _bayes(**prior):
    def run(spark, sf):
        m = L.BayesianLinearRegression(["q"], "y", mu=0.5, v=2.0, **prior).fit(_items(spark, sf))
        return _coefficients(spark, ["intercept", "q", "scale"], [*m.mean, m.scale])

    return run


def _bayes_predict(spark, sf):
    m = L.BayesianLinearRegression(["q"], "y", mu=0.5, v=2.0, sigma=3.0).fit(_items(spark, sf))
    return m.predict(_items(spark, sf)).groupBy("flag").agg(rounded(F.avg("mean"), 5).alias("mean"), rounded(F.avg("variance"), 5).alias("variance"))


_BETA = np.array([-0.5, 0.01, 2.0])
_START = {"identity": np.array([1.0, 2.0]), "log": np.array([3.5, 0.1]), "logit": np.array([-0.8, 0.3])}


def _two(w: str, x: str, z: str, source: str = "li", add: float = 0.0, more: str = "0.0") -> str:
    """Both coefficients of a weighted regression of z on x by Cramer's rule; add goes onto the diagonal."""
    return f"""s as (select sum({w}) + {add} as n, sum({w} * {x}) as sx, sum({w} * {x} * {x}) + {add} as sxx, sum({w} * {z}) + {more} as sy, sum({w} * {x} * {z}) + {more} as sxy from {source}),
 b as (select (sy * sxx - sx * sxy) / (n * sxx - sx * sx) as b0, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b1 from s)"""


def _listed(names: list[str], columns: list[str], source: str = "b") -> str:
    return " union all ".join(f"select '{n}' as term, round({c}, 6) + 0.0 as value from {source}" for n, c in zip(names, columns, strict=True))


_OLS = f"with {ITEMS_SQL}, b as (select regr_intercept(y, q) as b0, regr_slope(y, q) as b1 from li) {_listed(['intercept', 'q'], ['b0', 'b1'])}"
_SUM_TERMS = [f"select '{a}*{b}' as term, round(sum(({x})::double * {z}), 5) as value from li" for i, (a, x) in enumerate([("1", "1.0"), ("q", "q"), ("d", "d"), ("t", "t")]) for b, z in [("1", "1.0"), ("q", "q"), ("d", "d"), ("t", "t")][i:]]
_SUM_TERMS += [f"select '{a}*y', round(sum({x} * y), 5) from li" for a, x in (("1", "1.0"), ("q", "q"), ("d", "d"), ("t", "t"))]
_P = "1 / (1 + exp(-(-0.5 + 0.01 * q + 2.0 * d)))"
_BAYES = f"with {ITEMS_SQL}, {_two('1.0', 'q', 'y', add=0.5, more='0.25')}"


def _glm_sql(link: str) -> str:
    b0, b1 = (float(v) for v in _START[link])
    eta, y = f"({b0} + {b1} * d)", "r" if link == "logit" else "y"
    mean = {"identity": eta, "log": f"exp{eta}", "logit": f"(1 / (1 + exp(-{eta})))"}[link]
    slope = {"identity": "1.0::double", "log": mean, "logit": f"({mean} * (1 - {mean}))"}[link]
    return f"with {ITEMS_SQL}, i as (select {slope} as w, d as x, {eta} + ({y} - {mean}) / {slope} as z from li), {_two('w', 'x', 'z', 'i')} {_listed(['intercept', 'd'], ['b0', 'b1'])}"


_NB = f"""with {ITEMS_SQL}, c as (select flag as _label, count(*) as _n, avg(q) as q_mean, var_pop(q) + 1e-6 as q_var, avg(d) as d_mean, var_pop(d) + 1e-6 as d_var,
 avg(y) as y_mean, var_pop(y) + 1e-6 as y_var from li group by 1), n as (select sum(_n) as total from c)"""

QUERIES = {
    "ols_simple": _ols_simple,
    "ols_weighted": _ols_weighted,
    "ols_update": _ols_update,
    "ols_multi_sums": _ols_multi_sums,
    "ols_multi_predict": _ols_multi_predict,
    "ridge": _ridge,
    "ridge_predict": _ridge_predict,
    "logistic_gradient": _logistic_step,
    "logistic_fit": _logistic_fit,
    "logistic_predict": _logistic_predict,
    "glm_step_identity": _glm_step("identity"),
    "glm_step_log": _glm_step("log"),
    "glm_step_logit": _glm_step("logit"),
    "glm_fit": _glm_fit,
    "gaussian_nb_fit": _nb_fit,
    "gaussian_nb_predict": _nb_predict,
    "bayes_known_variance": _bayes(sigma=3.0),
    "bayes_unknown_variance": _bayes(),
    "bayes_predict": _bayes_predict,
}
ORACLES = {
    "ols_simple": _OLS,
    "ols_update": _OLS,
    "ols_weighted": f"with {ITEMS_SQL}, {_two('(1 + d)', 'q', 'y')} {_listed(['intercept', 'q'], ['b0', 'b1'])}",
    "ols_multi_sums": f"with {ITEMS_SQL} {' union all '.join(_SUM_TERMS)}",
    "ols_multi_predict": f"with {ITEMS_SQL} select count(*)::bigint as n, 0.0::double as sum_e, 0.0::double as sum_ed, round(avg(r), 6) as mean_r from li",
    "ridge": f"with {ITEMS_SQL}, {_two('1.0', 'q', 'y', add=100.0)} {_listed(['intercept', 'q'], ['b0', 'b1'])}",
    "ridge_predict": f"with {ITEMS_SQL}, {_two('1.0', 'q', 'y', add=100.0)} select flag, round(avg(b0 + b1 * q), 5) as mean from li, b group by 1",
    "logistic_gradient": f"""with {ITEMS_SQL}, p as (select *, {_P} as p from li), b as (select count(*) as n,
 sum(-r * ln(p) - (1 - r) * ln(1 - p)) + 2.0 * 0.5 * (0.25 + 0.0001 + 4.0) as l, sum(p - r) + 2 * -0.5 as g0, sum((p - r) * q) + 2 * 0.01 as g1, sum((p - r) * d) + 2 * 2.0 as g2 from p)
 {_listed(['loss', 'intercept', 'q', 'd'], ['l / n', 'g0 / n', 'g1 / n', 'g2 / n'])}""",
    "logistic_predict": f"with {ITEMS_SQL} select flag, round(avg({_P}), 6) as p from li group by 1",
    **{f"glm_step_{k}": _glm_sql(k) for k in ("identity", "log", "logit")},
    "gaussian_nb_fit": f"""{_NB} select _label, _n::bigint as _n, round(_n / total::double, 6) as prior, round(q_mean, 6) as q_mean, round(q_var, 6) as q_var, round(d_mean, 6) as d_mean,
 round(d_var, 6) as d_var, round(y_mean, 6) as y_mean, round(y_var, 6) as y_var from c, n""",
    "gaussian_nb_predict": f"""{_NB}, s as (select rid, flag, _label, ln(_n / total::double)
 {' '.join(f"- 0.5 * ln(2 * pi() * {f}_var) - 0.5 * pow({f} - {f}_mean, 2) / {f}_var" for f in "qdy")} as s from (select *, row_number() over () as rid from li) li, c, n),
 r as (select *, row_number() over (partition by rid order by s desc, _label) as k from s)
 select flag, _label as prediction, count(*)::bigint as n from r where k = 1 group by 1, 2""",
    "bayes_known_variance": f"{_BAYES} {_listed(['intercept', 'q', 'scale'], ['b0', 'b1', '9.0::double'])}",
    "bayes_unknown_variance": f"""{_BAYES}, e as (select *, (4.0 + (select sum(y * y) from li) + 0.25 - (b0 * sy + b1 * sxy)) / (2.0 + (select count(*) from li)) as scale from b, s)
 {_listed(['intercept', 'q', 'scale'], ['b0', 'b1', 'scale'], 'e')}""",
    "bayes_predict": f"""{_BAYES}, v as (select *, n * sxx - sx * sx as det from b, s)
 select flag, round(avg(b0 + b1 * q), 5) as mean, round(avg(9 + 9 * (sxx - 2 * sx * q + n * q * q) / det), 5) as variance from li, v group by 1""",
}
