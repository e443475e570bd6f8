"""Encoder and scaler queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import features as E
from quern.plans.common import rounded, table

COLUMNS = ["l_quantity", "l_extendedprice", "l_discount"]


def _items(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", *COLUMNS)


def _summary(df):
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), *(rounded(f(c), 5).alias(f"{k}_{c}") for c in COLUMNS for k, f in (("avg", F.avg), ("max", F.max))))


def _standardize(spark, sf):
    return _summary(E.Standardizer(COLUMNS).fit(_items(spark, sf)).transform(_items(spark, sf)))


def _standardize_inverse(spark, sf):
    s = E.Standardizer(COLUMNS).fit(_items(spark, sf))
    return _summary(s.inverse_transform(s.transform(_items(spark, sf))))


def _one_hot(spark, sf):
    e = table(spark, sf, "events")
    enc = E.OneHotEncoder().fit(e, "event_type")
    hot = e.select("event_id", enc.transform(F.col("event_type")).alias("x"))
    return hot.select("event_id", F.array_join(F.transform("x", lambda v: v.cast("int").cast("string")), "").alias("x"))


def _one_hot_inverse(spark, sf):
    e = table(spark, sf, "events")
    enc = E.OneHotEncoder().fit(e, "event_type")
    back = e.select("event_type", enc.inverse_transform(enc.transform(F.col("event_type"))).alias("back"))
    return back.groupBy("event_type", "back").agg(F.count("*").alias("n"))


def _features():
    return F.create_map(F.concat(F.lit("type="), "event_type"), F.lit(1.0), F.concat(F.lit("user="), F.col("user_id").cast("string")), F.col("value"))


def _hash(spark, sf):
    out = E.feature_hash(table(spark, sf, "events"), "event_id", _features(), 97)
    return out.select("event_id", "col", rounded("value", 5).alias("value"))


def _hash_dense(spark, sf):
    out = E.feature_hash_dense(table(spark, sf, "events"), "event_id", _features(), 64)
    return out.select("event_id", F.size("x").alias("dims"), rounded(F.aggregate("x", F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


def _minibatch(spark, sf):
    b = E.minibatches(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 256, "o_orderkey")
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"), rounded(F.sum("o_totalprice"), 2).alias("total"))


def _minibatch_shuffled(spark, sf):
    b = E.minibatches(table(spark, sf, "orders").select("o_orderkey"), 256, "o_orderkey", seed=3)
    return b.groupBy("batch").agg(F.count("*").alias("n"))


_STATS = "st as (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in COLUMNS) + " from lineitem)"
_MD5 = "list_reduce(list_prepend(0::bigint, [('0x' || substr(md5({0}), 4*i+1, 4))::bigint for i in range(0, 8)]), lambda a, c: (a * 65536 + c) % {1})"
_PAIRS = "f as (select event_id, 'type=' || event_type as feature, 1.0::double as value from events union all select event_id, 'user=' || user_id::varchar, value from events)"

QUERIES = {
    "standardize": _standardize,
    "standardize_inverse": _standardize_inverse,
    "one_hot": _one_hot,
    "one_hot_inverse": _one_hot_inverse,
    "feature_hash": _hash,
    "feature_hash_dense": _hash_dense,
    "minibatch": _minibatch,
    "minibatch_shuffled": _minibatch_shuffled,
}
ORACLES = {
    "standardize": f"with {_STATS} select l_returnflag, count(*)::bigint as n, " + ", ".join(f"round({k}(({c} - m_{c}) / s_{c}), 5) + 0.0 as {k}_{c}" for c in COLUMNS for k in ("avg", "max")) + " from lineitem, st group by 1",
    "standardize_inverse": "select l_returnflag, count(*)::bigint as n, " + ", ".join(f"round({k}({c}), 5) + 0.0 as {k}_{c}" for c in COLUMNS for k in ("avg", "max")) + " from lineitem group by 1",
    "one_hot": "with c as (select list(distinct event_type order by event_type) as c from events) select event_id, array_to_string([(x = event_type)::int for x in c], '') as x from events, c",
    "one_hot_inverse": "select event_type, event_type as back, count(*)::bigint as n from events group by 1, 2",
    "feature_hash": f"with {_PAIRS} select event_id, {_MD5.format('feature', 97)} as col, round(sum(value), 5) + 0.0 as value from f group by 1, 2",
    "feature_hash_dense": f"with {_PAIRS} select event_id, 64 as dims, round(sum(value), 5) + 0.0 as total from f group by 1",
    "minibatch": """with r as (select *, (row_number() over (order by o_orderkey) - 1) // 256 as batch from orders)
 select batch, count(*)::bigint as n, min(o_orderkey) as lo, max(o_orderkey) as hi, round(sum(o_totalprice), 2) as total from r group by 1""",
    "minibatch_shuffled": "select batch, least(256, (select count(*) from orders) - batch * 256)::bigint as n from (select unnest(range(0, ((select count(*) from orders) + 255) // 256)) as batch)",
}
