"""Tree queries on line items and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import trees as T
from quern.plans.common import rounded, table

FLAGS = ["A", "N", "R"]


def _items(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / 1000).alias("y")
    )


def _impurity(criterion, target):
    return lambda spark, sf: T.group_impurity(_items(spark, sf), "d", target, criterion).select("d", rounded("impurity", 6).alias("impurity"))


def _splits(criterion):
    def run(spark, sf):
        tree = T.DecisionTree(["q", "d", "t"], "y" if criterion == "mse" else "flag", None if criterion == "mse" else FLAGS, criterion=criterion)
        s = tree.splits(tree.histogram(_items(spark, sf), F.lit(0), F.lit(1.0)))
        return s.select("f", rounded("threshold", 6).alias("threshold"), rounded("gain", 8).alias("gain"))

    return run


def _best(spark, sf):
    tree = T.DecisionTree(["q", "d", "t"], "y")
    b = tree.best(tree.splits(tree.histogram(_items(spark, sf), F.lit(0), F.lit(1.0))))
    return b.select("f", rounded("threshold", 6).alias("threshold"), rounded("gain", 5).alias("gain"))


def _stump(spark, sf):
    tree = T.DecisionTree(["q", "d", "t"], "y", max_depth=1).fit(_items(spark, sf))
    return tree.predict(_items(spark, sf)).groupBy(rounded("prediction", 5).alias("prediction")).agg(F.count("*").alias("n"))


def _tree_classify(spark, sf):
    tree = T.DecisionTree(["q", "d", "t", "y"], "flag", FLAGS, max_depth=4).fit(_items(spark, sf))
    out = tree.predict(_items(spark, sf)).withColumn("p", F.aggregate(tree.class_probabilities(), F.lit(0.0), lambda a, b: a + b))
    return out.groupBy("flag", "prediction").agg(F.count("*").alias("n"), F.avg("p").alias("p"))


def _forest(spark, sf):
    f = T.RandomForest(["q", "d", "t"], "y", "l_orderkey", n_trees=3, max_depth=2, n_feats=2).fit(_items(spark, sf))
    return f.predict(_items(spark, sf)).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse"), F.var_pop("y").alias("variance"))


def _vote(spark, sf):
    """The vote of three given classifiers."""
    p = [F.when(F.col(c) > v, "N").otherwise(o) for c, v, o in (("q", 25, "A"), ("d", 0.05, "R"), ("t", 0.04, "A"))]
    return _items(spark, sf).withColumn("prediction", T.vote(p, FLAGS)).groupBy("prediction").agg(F.count("*").alias("n"))


def _bootstrap(spark, sf):
    w = T.poisson(F.col("o_orderkey"), 1)
    return table(spark, sf, "orders").select(w.alias("w")).groupBy("w").agg(F.count("*").alias("n"))


def _gbdt_residual(spark, sf):
    """The base prediction and the first round's negative gradient."""
    rows = _items(spark, sf)
    base = rows.agg(F.avg("y").alias("base"))
    g = rows.crossJoin(F.broadcast(base)).withColumn("g", -T.loss_gradient(F.col("y"), F.col("base"), "mse"))
    return g.groupBy("flag").agg(rounded(F.max("base"), 5).alias("base"), rounded(F.sum("g"), 2).alias("g"))


def _gbdt(step):
    def run(spark, sf):
        rows = _items(spark, sf)
        m = T.GradientBoostedDecisionTree(["q", "d"], "y", n_iter=2, max_depth=2, step_size=step).fit(rows)
        return m.predict(rows).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("y") - F.col("prediction"), 2)).alias("mse"), F.var_pop("y").alias("variance"))

    return run


def _gbdt_classify(spark, sf):
    rows = _items(spark, sf)
    m = T.GradientBoostedDecisionTree(["q", "d"], "flag", FLAGS, n_iter=1, max_depth=1, loss="crossentropy").fit(rows)
    return m.predict(rows).groupBy("prediction").agg(F.count("*").alias("n"))


def _losses(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("value") / 100).alias("y"), F.lit(0.4).alias("p"))
    ce = -F.sum(F.col("y") * F.log(F.col("p") + 2.220446049250313e-16))
    search = F.sum((F.col("y") - F.col("p")) * F.col("y")) / F.sum(F.col("y") * F.col("y"))
    return rows.groupBy("event_type").agg(rounded(F.avg(F.pow(F.col("y") - F.col("p"), 2)), 6).alias("mse"), rounded(ce, 4).alias("cross_entropy"), rounded(search, 6).alias("line_search"), rounded(F.avg("y"), 6).alias("base"))


def _one_hot(spark, sf):
    return _items(spark, sf).select(*((F.col("flag") == c).cast("double").alias(f"is_{c.lower()}") for c in FLAGS)).agg(*(F.sum(f"is_{c.lower()}").alias(f"is_{c.lower()}") for c in FLAGS))


IT = "it as (select l_quantity as q, l_discount as d, l_tax as t, l_returnflag as flag, l_extendedprice / 1000 as y from lineitem)"


def _impurity_sql(criterion: str) -> str:
    if criterion == "mse":
        return f"with {IT} select d, round(var_pop(y), 6) as impurity from it group by 1"
    score = "1 - sum(p * p)" if criterion == "gini" else "-sum(p * log2(p))"
    return f"with {IT}, c as (select d, flag, count(*) as n from it group by 1, 2), p as (select d, n::double / sum(n) over (partition by d) as p from c) select d, round({score}, 6) + 0.0 as impurity from p group by 1"


def _splits_sql(criterion: str, tail: str = "") -> str:
    stats = ["count(*)", "sum(y)", "sum(y * y)"] if criterion == "mse" else [f"sum((flag = '{c}')::int)" for c in FLAGS]
    k = range(3)

    def imp(c: str) -> str:
        if criterion == "mse":
            return f"greatest({c}2 / {c}0 - pow({c}1 / {c}0, 2), 0)"
        n = f"({c}0 + {c}1 + {c}2)"
        if criterion == "gini":
            return "(1 - " + " - ".join(f"pow({c}{i} / {n}, 2)" for i in k) + ")"
        return "(-(" + " + ".join(f"(case when {c}{i} > 0 then {c}{i} / {n} * log2({c}{i} / {n}) else 0 end)" for i in k) + "))"

    n = (lambda c: f"{c}0") if criterion == "mse" else (lambda c: f"({c}0 + {c}1 + {c}2)")
    h = " union all ".join(f"select {i} as f, {c}::double as v, {', '.join(f'{s}::double as s{j}' for j, s in enumerate(stats))} from it group by 2" for i, c in enumerate("qdt"))
    return f"""with {IT}, h as ({h}), w as (select f, v, lead(v) over o as nxt, {', '.join(f'sum(s{i}) over (o rows unbounded preceding) as l{i}, sum(s{i}) over (partition by f) as t{i}' for i in k)} from h window o as (partition by f order by v)),
 x as (select *, {', '.join(f't{i} - l{i} as r{i}' for i in k)} from w where nxt is not null),
 g as (select f, (v + nxt) / 2 as threshold, {imp('t')} - ({n('l')} * {imp('l')} + {n('r')} * {imp('r')}) / {n('t')} as gain, l0, l1, t0, t1 from x) {tail}"""


_ALL = "select f, round(threshold, 6) as threshold, round(gain, 8) + 0.0 as gain from g"
_TOP = "select f, threshold, gain, l0, l1, t0, t1 from g order by round(gain, 12) desc, f, threshold limit 1"

QUERIES = {
    "impurity_entropy": _impurity("entropy", "flag"),
    "impurity_gini": _impurity("gini", "flag"),
    "impurity_mse": _impurity("mse", "y"),
    "splits_entropy": _splits("entropy"),
    "splits_gini": _splits("gini"),
    "splits_mse": _splits("mse"),
    "best_split": _best,
    "stump_predict": _stump,
    "tree_classify": _tree_classify,
    "bootstrap_weights": _bootstrap,
    "random_forest": _forest,
    "forest_vote": _vote,
    "gbdt_first_residual": _gbdt_residual,
    "gbdt_constant": _gbdt("constant"),
    "gbdt_adaptive": _gbdt("adaptive"),
    "gbdt_classify": _gbdt_classify,
    "tree_losses": _losses,
    "tree_one_hot": _one_hot,
}
ORACLES = {
    **{f"impurity_{c}": _impurity_sql(c) for c in T.CRITERIA},
    **{f"splits_{c}": _splits_sql(c, _ALL) for c in T.CRITERIA},
    "best_split": _splits_sql("mse", f", b as ({_TOP}) select f, round(threshold, 6) as threshold, round(gain, 5) as gain from b"),
    "stump_predict": _splits_sql("mse", f""", b as ({_TOP}) select round(case when (case f when 0 then q when 1 then d else t end) < threshold then l1 / l0 else (t1 - l1) / (t0 - l0) end, 5) as prediction, count(*)::bigint as n
 from it, b group by 1"""),
    "forest_vote": f"""with {IT}, p as (select case when q > 25 then 'N' else 'A' end as a, case when d > 0.05 then 'N' else 'R' end as b, case when t > 0.04 then 'N' else 'A' end as c from it)
 select case when (a = 'A')::int + (b = 'A')::int + (c = 'A')::int >= greatest((a = 'N')::int + (b = 'N')::int + (c = 'N')::int, (a = 'R')::int + (b = 'R')::int + (c = 'R')::int) then 'A'
 when (a = 'N')::int + (b = 'N')::int + (c = 'N')::int >= (a = 'R')::int + (b = 'R')::int + (c = 'R')::int then 'N' else 'R' end as prediction, count(*)::bigint as n from p group by 1""",
    "gbdt_first_residual": f"with {IT}, b as (select avg(y) as base from it) select flag, round(max(base), 5) as base, round(sum(2 * (y - base)), 2) + 0.0 as g from it, b group by 1",
    "tree_losses": """with r as (select event_type, value / 100 as y, 0.4::double as p from events) select event_type, round(avg(pow(y - p, 2)), 6) as mse, round(-sum(y * ln(p + 2.220446049250313e-16)), 4) + 0.0 as cross_entropy,
 round(sum((y - p) * y) / sum(y * y), 6) + 0.0 as line_search, round(avg(y), 6) + 0.0 as base from r group by 1""",
    "tree_one_hot": f"with {IT} select " + ", ".join(f"sum((flag = '{c}')::int)::double as is_{c.lower()}" for c in FLAGS) + " from it",
}
