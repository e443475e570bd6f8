"""Neural queries: activations, losses, schedules, optimizers, and layers on tensors in long form."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import neural as N
from quern.functions import vector as X
from quern.operators import tensor as TN
from quern.plans.common import rounded, table


def _z(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("value") / 25 - 2).alias("z"))


def _activation(name):
    a = N.ACTIVATIONS[name]
    return lambda s, d: _z(s, d).select("event_id", rounded(a.fn(F.col("z"))).alias("f"), rounded(a.grad(F.col("z"))).alias("g"), rounded(a.grad2(F.col("z"))).alias("g2"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), X.doubles(F.col("embedding")).alias("x"), "label")


def _losses(spark, sf):
    v = _vectors(spark, sf).withColumn("p", X.softmax(F.col("x"))).withColumn("y", F.transform("x", lambda _, i: (i == F.col("label")).cast("double")))
    v = v.withColumn("half", F.slice("x", 1, 32)).withColumn("rest", F.slice("x", 33, 32))
    return v.select(
        "id", rounded(N.squared_error(F.col("y"), F.col("p"))).alias("squared"), rounded(N.cross_entropy(F.col("y"), F.col("p"))).alias("cross_entropy"),
        rounded(N.vae_loss(F.col("y"), F.col("p"), F.col("half"), F.col("rest")), 5).alias("vae"), rounded(N.nce_loss(F.col("x")[0], F.col("half"))).alias("nce"),
    )


def _loss_gradients(spark, sf):
    """Gradients of both losses by the logits: of softmax with cross-entropy p - y, and (p - y) act'(z)."""
    v = _vectors(spark, sf).withColumn("p", X.softmax(F.col("x")))
    d = v.select("id", F.posexplode("p").alias("k", "p"), "label", "x")
    y = (F.col("k") == F.col("label")).cast("double")
    return d.groupBy("k").agg(rounded(F.sum(F.col("p") - y), 5).alias("cross_entropy"), rounded(F.sum((F.col("p") - y) * N.ACTIVATIONS["tanh"].grad(F.get("x", F.col("k")))), 5).alias("squared"))


def _wgan_value(spark, sf):
    """Critic's loss for real (flag R) and fake rows with given gradient norms."""
    i = table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").alias("real"), (F.col("l_extendedprice") / 10_000).alias("c"), (F.col("l_quantity") / 25).alias("norm"))
    out = i.agg(F.avg(F.when(~F.col("real"), F.col("c"))).alias("fake"), F.avg(F.when(F.col("real"), F.col("c"))).alias("own"), F.avg(F.pow(F.col("norm") - 1, 2)).alias("gp"))
    return out.select(rounded(F.col("fake") - F.col("own") + 10 * F.col("gp"), 5).alias("critic"), rounded(-F.col("fake"), 5).alias("generator"))


def _schedules(spark, sf):
    s = spark.range(1, 2001).select(F.col("id").cast("int").alias("step"))
    c = F.col("step")
    return s.select(
        "step", rounded(N.constant_schedule(c), 9).alias("constant"), rounded(N.exponential_schedule(c), 9).alias("exponential"),
        rounded(N.exponential_schedule(c, staircase=True), 9).alias("staircase"), rounded(N.noam_schedule(c, warmup=400), 9).alias("noam"),
    )


def _king(spark, sf):
    k = N.KingScheduler(patience=5)
    return spark.createDataFrame([(i, float(k(loss))) for i, loss in enumerate([1 / (1 + i) for i in range(15)] + [0.1 + 0.001 * i for i in range(30)])], "step int, lr double")


def _king_slope(spark, sf):
    """The slope of recent values that the scheduler rests on, as a window."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("t", F.row_number().over(w).cast("double"))
    slope = F.regr_slope("value", "t").over(w.rowsBetween(-9, 0))
    return e.select("event_id", rounded(slope, 5).alias("slope"))


def _gradients(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select("user_id", F.transform("e", lambda v: v["value"] / 50 - 1).alias("g"))


def _optimizer(make):
    return lambda s, d: _gradients(s, d).select("user_id", F.posexplode(make(F.col("g"))).alias("t", "w")).select("user_id", "t", rounded("w", 9).alias("w"))


def _softmax(spark, sf):
    return _vectors(spark, sf).select("id", F.posexplode(X.softmax(F.col("x"))).alias("k", "v")).select("id", "k", rounded("v").alias("v"))


#: Fixed weights of layers: w[j][i] from input i to unit j.
def weight(j: int, i: int) -> float:
    return ((7 * j + 3 * i) % 11 - 5) / 10


DENSE_W, DENSE_B = [[weight(j, i) for i in range(64)] for j in range(4)], [0.1 * j for j in range(4)]


def _dense(spark, sf):
    y = N.dense(F.col("x"), DENSE_W, DENSE_B, N.activation("relu"))
    return _vectors(spark, sf).select("id", F.posexplode(y).alias("k", "v")).select("id", "k", rounded("v", 5).alias("v"))


def _layer_norm(spark, sf):
    return _vectors(spark, sf).select("id", F.posexplode(N.layer_norm(F.col("x"))).alias("k", "v")).select("id", "k", rounded("v", 5).alias("v"))


def _batch_norm(spark, sf):
    v = _vectors(spark, sf).select("id", F.posexplode("x").alias("k", "v"))
    stats = v.groupBy("k").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))  # a row per feature
    return v.join(F.broadcast(stats), "k").select("id", "k", rounded((F.col("v") - F.col("m")) / F.sqrt(F.col("s") + 1e-5), 5).alias("v"))


def _merge(spark, sf):
    half, rest = F.slice("x", 1, 32), F.slice("x", 33, 32)
    relu = N.activation("relu").fn
    add, mul = F.zip_with(half, rest, lambda a, b: relu(a + b)), F.zip_with(half, rest, lambda a, b: N.activation("tanh").fn(a * b))
    return _vectors(spark, sf).select("id", F.posexplode(F.arrays_zip(add.alias("a"), mul.alias("m"))).alias("k", "v")).select("id", "k", rounded("v.a").alias("added"), rounded("v.m").alias("multiplied"))


def _flatten(spark, sf):
    nested = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("x", r * 8 + 1, 8))
    return _vectors(spark, sf).select("id", F.size(F.flatten(nested)).alias("n"), (F.flatten(nested) == F.col("x")).alias("same"))


def _embedding(spark, sf):
    """Rows of a table, all of them in turn, looked up by id and pooled per user."""
    vectors = _vectors(spark, sf)
    ids = table(spark, sf, "events").select("user_id", (F.col("event_id") % F.lit(vectors.count())).alias("id"))
    rows = ids.join(vectors, "id").select("user_id", F.posexplode("x").alias("k", "v"))
    return rows.groupBy("user_id", "k").agg(rounded(F.sum("v"), 5).alias("total"), rounded(F.avg("v"), 5).alias("mean"))


def _attention(spark, sf):
    """Scaled dot-product attention of the query set over all vectors of its label, values being the vectors."""
    v = _vectors(spark, sf)
    q = v.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("x").alias("qx"), "label")
    s = v.join(q, "label").select("q", "x", (X.dot(F.col("x"), F.col("qx")) / 8.0).alias("s"))
    top = s.groupBy("q").agg(F.max("s").alias("m"))
    e = s.join(top, "q").select("q", "x", F.exp(F.col("s") - F.col("m")).alias("e"))
    out = e.select("q", "e", F.posexplode("x").alias("k", "v")).groupBy("q", "k").agg(F.sum(F.col("e") * F.col("v")).alias("n"), F.sum("e").alias("d"))
    return out.select("q", "k", rounded(F.col("n") / F.col("d"), 5).alias("v"))


def _images(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("ex"), F.posexplode(X.doubles(F.col("embedding"))).alias("p", "v"))
    return e.select("ex", F.floor(F.col("p") / 8).cast("int").alias("row"), (F.col("p") % 8).cast("int").alias("col"), F.lit(0).alias("ch"), "v")


KERNEL = [(r, c, o, (2 * r + 3 * c + o) % 5 / 2 - 1) for r in range(3) for c in range(3) for o in range(2)]


def _kernel(spark):
    return spark.createDataFrame([(r, c, 0, o, float(v)) for r, c, o, v in KERNEL], "fr int, fc int, in_ch int, out_ch int, w double")


def _conv(stride, pad, dilation):
    def run(spark, sf):
        out = TN.conv2d(_images(spark, sf), _kernel(spark), (8, 8), (3, 3), stride, pad, dilation)
        return out.select("ex", "row", "col", "ch", rounded("v", 5).alias("v"))

    return run


def _deconv(spark, sf):
    return TN.deconv2d(_images(spark, sf), _kernel(spark), 2, 0).select("ex", "row", "col", "ch", rounded("v", 5).alias("v"))


def _conv1d(spark, sf):
    """A causal convolution of the vectors, as images of one row."""
    line = _vectors(spark, sf).select(F.col("id").alias("ex"), F.lit(0).alias("row"), F.posexplode("x").alias("col", "v")).withColumn("ch", F.lit(0)).select("ex", "row", "col", "ch", "v")
    shifted = line.withColumn("col", F.col("col") + 4)
    kernel = spark.createDataFrame([(0, k, 0, 0, float(k - 1)) for k in range(3)], "fr int, fc int, in_ch int, out_ch int, w double")
    out = TN.conv2d(shifted, kernel, (1, 68), (1, 3), 1, 0, 1)
    return out.select("ex", "col", rounded("v", 5).alias("v"))


def _pool(mode):
    return lambda s, d: TN.pool2d(_images(s, d), (8, 8), (2, 2), 2, 0, mode).select("ex", "row", "col", "ch", rounded("v", 5).alias("v"))


def _pad(spark, sf):
    return TN.pad2d(_images(spark, sf), (8, 8), 1, 2).select("ex", "row", "col", rounded("v", 5).alias("v"))


def _dilate(spark, sf):
    return TN.dilate(_images(spark, sf), (8, 8), 1).select("ex", "row", "col", rounded("v", 5).alias("v"))


def _col2im(spark, sf):
    """What a sum of all patches makes of an image: each pixel times the number of patches that hold it."""
    return TN.col2im(TN.im2col(_images(spark, sf), (8, 8), (3, 3), 1, 0)).select("ex", "row", "col", rounded("v", 5).alias("v"))


def _pad1d(spark, sf):
    return _vectors(spark, sf).select("id", F.size(N.pad1d(F.col("x"), 2, 3)).alias("n"), rounded(F.aggregate(N.pad1d(F.col("x"), 2, 3), F.lit(0.0), lambda a, b: a + b), 5).alias("total"))


RNN = dict(wax=[[0.5], [-0.3]], waa=[[0.1, 0.2], [-0.2, 0.4]], b=[0.05, -0.05])


def _rnn(spark, sf):
    xs = F.transform("g", lambda v: F.array(v))
    return _gradients(spark, sf).select("user_id", F.posexplode(N.rnn(xs, **RNN, act=N.activation("tanh"))).alias("t", "a")).select("user_id", "t", rounded(F.col("a")[0]).alias("a0"), rounded(F.col("a")[1]).alias("a1"))


def _dropout(spark, sf):
    """Kept values are scaled up; which are kept follows from a hash."""
    v = _vectors(spark, sf).select("id", F.posexplode("x").alias("k", "v"))
    kept = F.pmod(F.xxhash64("id", "k"), F.lit(100)) >= 20
    return v.agg(F.count("*").alias("n"), F.avg(kept.cast("double")).alias("share"), F.sum(F.when(kept, F.col("v") / 0.8).otherwise(0.0)).alias("total"))


C0 = math.sqrt(2 / math.pi)
_T = f"tanh({C0} * (z + 0.044715 * z * z * z))"
_S = "(1 / (1 + exp(-z)))"
_X = "abs(z) / sqrt(2.0)"
_TT = f"(1 / (1 + 0.3275911 * {_X}))"
_POLY = "((((({4} * t + {3}) * t + {2}) * t + {1}) * t + {0}) * t)".format(*N.ERF).replace(" t", f" {_TT}")
_CDF = f"(0.5 * (1 + (case when z < 0 then -1 else 1 end) * (1 - {_POLY} * exp(-z * z / 2))))"
_PDF = "(exp(-0.5 * z * z) / sqrt(2 * pi()))"
A, SC = N.SELU_ALPHA, N.SELU_SCALE
ACT_SQL = {
    "sigmoid": (_S, f"{_S} * (1 - {_S})", f"{_S} * (1 - {_S}) * (1 - 2 * {_S})"),
    "relu": ("greatest(z, 0)", "(z > 0)::int::double", "0.0 * z"),
    "leaky_relu": ("case when z < 0 then 0.3 * z else z end", "case when z < 0 then 0.3::double else 1 end", "0.0 * z"),
    "gelu": (f"0.5 * z * (1 + {_T})", f"0.5 * (1 + {_T}) + 0.5 * z * (1 - pow({_T}, 2)) * {C0} * (1 + 0.134145 * z * z)",
             f"(1 - pow({_T}, 2)) * ({C0} * (1 + 0.134145 * z * z) + 0.5 * z * {6 * C0 * 0.044715} * z - z * {_T} * pow({C0} * (1 + 0.134145 * z * z), 2))"),
    "gelu_exact": (f"z * {_CDF}", f"{_CDF} + z * {_PDF}", f"{_PDF} * (2 - z * z)"),
    "tanh": ("tanh(z)", "1 - pow(tanh(z), 2)", "-2 * tanh(z) * (1 - pow(tanh(z), 2))"),
    "affine": ("z", "1.0 + 0 * z", "0.0 * z"),
    "identity": ("z", "1.0 + 0 * z", "0.0 * z"),
    "elu": ("case when z > 0 then z else exp(z) - 1 end", "case when z > 0 then 1.0 else exp(z) end", "case when z > 0 then 0.0 else exp(z) end"),
    "exponential": ("exp(z)", "exp(z)", "exp(z)"),
    "selu": (f"{SC} * (case when z > 0 then z else {A} * (exp(z) - 1) end)", f"{SC} * (case when z > 0 then 1.0 else {A} * exp(z) end)", f"case when z > 0 then 0.0 else {SC * A} * exp(z) end"),
    "hard_sigmoid": ("least(greatest(0.2 * z + 0.5, 0), 1)", "case when z between -2.5 and 2.5 then 0.2::double else 0.0 end", "0.0 * z"),
    "softplus": ("ln(1 + exp(z))", _S, f"{_S} * (1 - {_S})"),
}


def _act_sql(name: str) -> str:
    f, g, g2 = ACT_SQL[name]
    return f"select event_id, round(({f})::double, 6) + 0.0 as f, round(({g})::double, 6) + 0.0 as g, round(({g2})::double, 6) + 0.0 as g2 from (select event_id, value / 25 - 2 as z from events)"


E_SQL = "e as (select vec_id as id, embedding::double[] as x, label from embeddings)"
P_SQL = f"{E_SQL}, p as (select *, [exp(v) / list_sum([exp(u) for u in x]) for v in x] as p from e)"
K64, K8 = "(select unnest(range(0, 64)) as k)", "(select unnest(range(0, 8)) as {})"
G_SQL = """g as (select user_id, value / 50 - 1 as g, row_number() over (partition by user_id order by ts, event_id) - 1 as t from events)"""
IMG = "im as (select vec_id as ex, p // 8 as r, p % 8 as c, embedding[p+1]::double as v from embeddings, (select unnest(range(0, 64)) as p))"
KER = "ker(fr, fc, o, w) as (values " + ", ".join(f"({r}, {c}, {o}, {v}::double)" for r, c, o, v in KERNEL) + ")"


def _optimizer_sql(state: str, start: str, step: str) -> str:
    return f"""with recursive {G_SQL}, f(user_id, t, w, {state}) as (select distinct user_id, -1::bigint, 0.0::double, {start} from g union all
 select f.user_id, g.t, {step} from f join g on g.user_id = f.user_id and g.t = f.t + 1) select user_id, t::int as t, round(w, 9) + 0.0 as w from f where t >= 0"""


def _conv_sql(stride: int, pad: int, dilation: int) -> str:
    d, n = dilation + 1, (8 + 2 * pad - (2 * (dilation + 1) + 1)) // stride + 1
    return f"""with {IMG}, {KER}, out as (select i, j from (select unnest(range(0, {n})) as i), (select unnest(range(0, {n})) as j))
 select ex, i::int as row, j::int as col, o::int as ch, round(sum(v * w), 5) + 0.0 as v from out, ker, im where r = i * {stride} + fr * {d} - {pad} and c = j * {stride} + fc * {d} - {pad} group by 1, 2, 3, 4"""


QUERIES = {
    **{f"activation_{k}": _activation(k) for k in N.ACTIVATIONS},
    "losses": _losses,
    "loss_gradients": _loss_gradients,
    "wgan_value": _wgan_value,
    "schedules": _schedules,
    "king_schedule": _king,
    "king_slope": _king_slope,
    "optimizer_sgd": _optimizer(lambda g: N.sgd(g, lr=0.1, momentum=0.9, clip=0.5)),
    "optimizer_adagrad": _optimizer(lambda g: N.adagrad(g, lr=0.1)),
    "optimizer_rmsprop": _optimizer(lambda g: N.rmsprop(g, lr=0.1)),
    "optimizer_adam": _optimizer(lambda g: N.adam(g, lr=0.1)),
    "layer_softmax": _softmax,
    "layer_dense": _dense,
    "layer_norm": _layer_norm,
    "batch_norm": _batch_norm,
    "layer_add_multiply": _merge,
    "layer_flatten": _flatten,
    "layer_embedding": _embedding,
    "layer_attention": _attention,
    "layer_rnn": _rnn,
    "layer_dropout": _dropout,
    "conv2d": _conv(1, 0, 0),
    "conv2d_stride_pad": _conv(2, 1, 0),
    "conv2d_dilated": _conv(1, 2, 1),
    "conv1d_causal": _conv1d,
    "deconv2d": _deconv,
    "pool2d_max": _pool("max"),
    "pool2d_average": _pool("average"),
    "pad1d": _pad1d,
    "pad2d": _pad,
    "dilate": _dilate,
    "im2col_col2im": _col2im,
}
_VSUM = "-0.5 * list_sum([1 + x[i+32] - x[i] * x[i] - exp(x[i+32]) for i in range(1, 33)])"
ORACLES = {
    **{f"activation_{k}": _act_sql(k) for k in ACT_SQL},
    "losses": f"""with {P_SQL} select id, round(0.5 * list_sum([pow(p[i] - (i - 1 = label)::int, 2) for i in range(1, 65)]), 6) as squared, round(-ln(p[label+1] + {N.EPS}), 6) as cross_entropy,
 round(-list_sum([case when i - 1 = label then ln(p[i]) else ln(1 - p[i]) end for i in range(1, 65)]) + {_VSUM}, 5) as vae, round(ln(1 + exp(-x[1])) + list_sum([ln(1 + exp(x[i])) for i in range(1, 33)]), 6) as nce from p""",
    "loss_gradients": f"""with {P_SQL} select k::int as k, round(sum(p[k+1] - (k = label)::int), 5) + 0.0 as cross_entropy, round(sum((p[k+1] - (k = label)::int) * (1 - pow(tanh(x[k+1]), 2))), 5) + 0.0 as squared from p, {K64} group by 1""",
    "wgan_value": """with i as (select l_returnflag = 'R' as own, l_extendedprice / 10000 as c, l_quantity / 25 as n from lineitem)
 select round(avg(case when not own then c end) - avg(case when own then c end) + 10 * avg(pow(n - 1, 2)), 5) as critic, round(-avg(case when not own then c end), 5) as generator from i""",
    "schedules": """select s::int as step, 0.01::double as constant, round(0.01 * pow(0.1, s / 500.0::double), 9) as exponential, round(0.01 * pow(0.1, floor(s / 500.0::double)), 9) as staircase,
 round(pow(512, -0.5) * least(pow(s, -0.5), s * pow(400, -1.5)), 9) as noam from (select unnest(range(1, 2001)) as s)""",
    "king_slope": """with e as (select *, row_number() over (partition by user_id order by ts, event_id)::double as t from events)
, s as (select event_id, t, regr_slope(value, t) over (partition by user_id order by ts, event_id rows between 9 preceding and current row) as slope from e)
 select event_id, case when t > 1 then round(slope, 5) + 0.0 end as slope from s""",
    "optimizer_sgd": _optimizer_sql("u", "0.0::double", "f.w - (0.9 * f.u + 0.1 * (case when abs(g) > 0.5 then 0.5 * sign(g) else g end)), 0.9 * f.u + 0.1 * (case when abs(g) > 0.5 then 0.5 * sign(g) else g end)"),
    "optimizer_adagrad": _optimizer_sql("c", "0.0::double", "f.w - 0.1 * g / (sqrt(f.c + g * g) + 1e-7), f.c + g * g"),
    "optimizer_rmsprop": _optimizer_sql("c", "0.0::double", "f.w - 0.1 * g / (sqrt(0.9 * f.c + 0.1 * g * g) + 1e-7), 0.9 * f.c + 0.1 * g * g"),
    "optimizer_adam": _optimizer_sql("m, s", "0.0::double, 0.0::double", "f.w - 0.1 * ((0.9 * f.m + 0.1 * g) / (1 - pow(0.9, g.t + 1))) / (sqrt((0.999 * f.s + 0.001 * g * g) / (1 - pow(0.999, g.t + 1))) + 1e-7), 0.9 * f.m + 0.1 * g, 0.999 * f.s + 0.001 * g * g"),
    "layer_softmax": f"with {P_SQL} select id, k::int as k, round(p[k+1], 6) as v from p, {K64}",
    "layer_dense": f"with {E_SQL} select id, j::int as k, round(greatest(list_sum([x[i+1] * ((7 * j + 3 * i) % 11 - 5) / 10 for i in range(0, 64)]) + 0.1 * j, 0), 5) + 0.0 as v from e, (select unnest(range(0, 4)) as j)",
    "layer_norm": f"with {E_SQL}, m as (select *, list_avg(x) as m, list_avg([v * v for v in x]) as q from e) select id, k::int as k, round((x[k+1] - m) / sqrt(q - m * m + 1e-5), 5) + 0.0 as v from m, {K64}",
    "batch_norm": f"with {E_SQL}, l as (select id, k, x[k+1] as v from e, {K64}), s as (select k, avg(v) as m, var_pop(v) as s from l group by 1) select id, k::int as k, round((v - m) / sqrt(s + 1e-5), 5) + 0.0 as v from l join s using (k)",
    "layer_add_multiply": f"with {E_SQL} select id, k::int as k, round(greatest(x[k+1] + x[k+33], 0), 6) + 0.0 as added, round(tanh(x[k+1] * x[k+33]), 6) + 0.0 as multiplied from e, (select unnest(range(0, 32)) as k)",
    "layer_flatten": f"with {E_SQL} select id, 64 as n, true as same from e",
    "layer_embedding": f"""with {E_SQL} select user_id, k::int as k, round(sum(x[k+1]), 5) + 0.0 as total, round(avg(x[k+1]), 5) + 0.0 as mean from events join e on e.id = event_id % (select count(*) from embeddings), {K64} group by 1, 2""",
    "layer_attention": f"""with {E_SQL}, s as (select q.id as q, e.x, exp(list_sum([e.x[i] * q.x[i] for i in range(1, 65)]) / 8) as w from e join e q on e.label = q.label where q.id % 50 = 0)
 select q, k::int as k, round(sum(w * x[k+1]) / sum(w), 5) + 0.0 as v from s, {K64} group by 1, 2""",
    "layer_rnn": f"""with recursive {G_SQL}, f(user_id, t, a, b) as (select distinct user_id, -1::bigint, 0.0::double, 0.0::double from g union all
 select f.user_id, g.t, tanh(0.5 * g + 0.1 * f.a + 0.2 * f.b + 0.05), tanh(-0.3 * g - 0.2 * f.a + 0.4 * f.b - 0.05) from f join g on g.user_id = f.user_id and g.t = f.t + 1)
 select user_id, t::int as t, round(a, 6) + 0.0 as a0, round(b, 6) + 0.0 as a1 from f where t >= 0""",
    "conv2d": _conv_sql(1, 0, 0),
    "conv2d_stride_pad": _conv_sql(2, 1, 0),
    "conv2d_dilated": _conv_sql(1, 2, 1),
    "conv1d_causal": """with e as (select vec_id as ex, embedding::double[] as x from embeddings) select ex, k::int as col,
 round(coalesce(x[k+1], 0) - coalesce(case when k >= 4 then x[k-3] end, 0), 5) + 0.0 as v from e, (select unnest(range(0, 64)) as k)""",
    "deconv2d": f"with {IMG}, {KER} select ex, (r * 2 + fr)::int as row, (c * 2 + fc)::int as col, o::int as ch, round(sum(v * w), 5) + 0.0 as v from im, ker group by 1, 2, 3, 4",
    **{f"pool2d_{k}": f"with {IMG} select ex, (r // 2)::int as row, (c // 2)::int as col, 0 as ch, round({f}(v), 5) + 0.0 as v from im group by 1, 2, 3" for k, f in (("max", "max"), ("average", "avg"))},
    "pad1d": f"with {E_SQL} select id, 69 as n, round(list_sum(x), 5) + 0.0 as total from e",
    "pad2d": f"with {IMG}, g as (select ex, i, j from (select distinct vec_id as ex from embeddings), (select unnest(range(0, 10)) as i), (select unnest(range(0, 12)) as j)) select g.ex, i::int as row, j::int as col, round(coalesce(v, 0), 5) + 0.0 as v from g left join im on im.ex = g.ex and r = i - 1 and c = j - 2",
    "dilate": f"with {IMG}, g as (select ex, i, j from (select distinct vec_id as ex from embeddings), (select unnest(range(0, 15)) as i), (select unnest(range(0, 15)) as j)) select g.ex, i::int as row, j::int as col, round(coalesce(v, 0), 5) + 0.0 as v from g left join im on im.ex = g.ex and r * 2 = i and c * 2 = j",
    "im2col_col2im": f"with {IMG} select ex, r::int as row, c::int as col, round(v * least(r + 1, 3, 8 - r) * least(c + 1, 3, 8 - c), 5) + 0.0 as v from im",
}
