"""Queries that train networks on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.functions import autodiff as A
from quern.operators import networks as N
from quern.operators import vocabulary as V
from quern.plans.common import rounded, table


def _images(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda v: 1.0 / (1.0 + F.exp(-4.0 * v.cast("double")))).alias("x"))


def _losses(spark, values):
    return spark.createDataFrame([(k, float(v), bool(v <= values[0] + 1e-9)) for k, v in enumerate(values)], "step int, loss double, below_start boolean")


def _mlp(spark, sf):
    """A dense classifier of labels with a soft-max cross-entropy."""
    rng = np.random.default_rng(0)
    params = N.dense_params(rng, "1", 64, 16) | N.dense_params(rng, "2", 16, 10)

    def loss(p, pdf, _):
        y = np.eye(10)[pdf["label"].to_numpy()]
        return -(A.log(A.softmax(N.dense(p, "2", N.dense(p, "1", A.Var(N.rows(pdf)), "tanh"))) + 1e-12) * y).sum()

    return _losses(spark, N.train(_images(spark, sf), params, loss, N.Optimizer("adam", 0.05), 4))


def _vae(spark, sf):
    return _losses(spark, N.BernoulliVAE(8).fit(_images(spark, sf), 3))


def _wgan(spark, sf):
    out = N.WGANGP(64).fit(_images(spark, sf), 2)
    return spark.createDataFrame([(k, float(c), float(g)) for k, (c, g) in enumerate(out)], "step int, critic double, generator double")


def _rbm(spark, sf):
    return _losses(spark, N.RBM(64, 16).fit(_images(spark, sf)))


def _tokens(spark, sf):
    """Benchmark items as arrays of word numbers in the alphabet."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.split(F.lower("text"), " ").alias("w"))
    rows = items.select("id", F.posexplode("w").alias("pos", "token"))
    vocab = V.Vocabulary.fit(rows).tokens
    words = rows.join(vocab.select("token", "count", "idx"), "token")
    return vocab, words.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "idx"))), lambda x: x["idx"].cast("int")).alias("words"))


def _pairs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split(F.lower("text"), r"\s+").alias("words"))
    return N.context_pairs(docs, 2).groupBy("target", "context").agg(F.count("*").alias("n"))


def _noise(spark, sf):
    counts = table(spark, sf, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    return N.noise_distribution(counts).select("token", rounded("p", 9).alias("p"))


def _w2v(spark, sf):
    vocab, docs = _tokens(spark, sf)
    noise = np.array([r["p"] for r in N.noise_distribution(vocab).join(vocab.select("token", "idx"), "token").orderBy("idx").collect()])
    m = N.Word2Vec(len(noise), noise / noise.sum())
    return _losses(spark, m.fit(N.context_pairs(docs, 2).select("target", "context"), 3))


def _modules(spark, sf):
    """Losses before and after steps of small modules that predict the mean of an image."""
    rng = np.random.default_rng(1)
    norm = lambda k, c: {f"{k}.g": np.ones(c), f"{k}.s": np.zeros(c)}
    conv = lambda k, *s: {f"{k}.w": N.initial(rng, s), f"{k}.b": np.zeros(s[-1])}
    head = lambda n: N.dense_params(rng, "head", n, 1)
    seq = lambda pdf: A.Var(N.rows(pdf).reshape(-1, 8, 8))
    img = lambda pdf: A.Var(N.rows(pdf).reshape(-1, 8, 8, 1))
    flat = lambda h: h.reshape(h.shape[0], -1)
    modules = {
        "rnn": (N.recurrent_params(rng, "r", 8, 4) | head(32), lambda p, d: N.rnn(p, "r", seq(d))),
        "bidirectional_lstm": (N.recurrent_params(rng, "r.fwd", 8, 3, 4) | N.recurrent_params(rng, "r.bwd", 8, 3, 4) | head(48), lambda p, d: N.bidirectional_lstm(p, "r", seq(d))),
        "multi_head_attention": ({k: v for s in "qkvo" for k, v in N.dense_params(rng, f"a.{s}", 8, 8).items()} | head(64), lambda p, d: N.multi_head(p, "a", seq(d), seq(d), seq(d), 2)),
        "wavenet": (conv("w.d", 1, 2, 8, 8) | conv("w.o", 1, 1, 8, 8) | head(64), lambda p, d: N.wavenet_block(p, "w", seq(d), None, 1)[1]),
        "skip_identity": (conv("s.c1", 3, 3, 1, 1) | conv("s.c2", 3, 3, 1, 1) | norm("s.n1", 1) | norm("s.n2", 1) | head(64), lambda p, d: N.residual_block(p, "s", img(d))),
        "skip_projection": (conv("s.c1", 3, 3, 1, 2) | conv("s.c2", 3, 3, 2, 2) | conv("s.cs", 1, 1, 1, 2) | norm("s.n1", 2) | norm("s.n2", 2) | norm("s.ns", 2) | head(32), lambda p, d: N.residual_block(p, "s", img(d), 2)),
        "deconv": (conv("s.c", 3, 3, 1, 1) | head(289), lambda p, d: N.deconv2d(p, "s.c", img(d), 2)),
    }
    out = []
    for name, (params, f) in modules.items():

        def loss(p, pdf, _, f=f):
            y = N.rows(pdf).mean(1, keepdims=True)
            return ((N.dense(p, "head", flat(f(p, pdf))) - y) ** 2.0).sum()

        values = N.train(_images(spark, sf), params, loss, N.Optimizer("adam", 0.01), 3)
        out.append((name, values[0], values[-1], bool(values[-1] < values[0])))
    return spark.createDataFrame(out, "module string, first double, last double, falls boolean")


def _initial(spark, sf):
    rng = np.random.default_rng(0)
    modes = ("he_uniform", "he_normal", "glorot_uniform", "glorot_normal", "std_normal", "trunc_normal")
    rows = [(m, float(np.abs(x := N.initial(rng, (200, 100), m)).max()), float(x.std())) for m in modes]
    return spark.createDataFrame(rows, "mode string, most double, std double")


def _sparse(spark, sf):
    m = N.SparseEvolution(64, 32)
    rows = []
    for k in range(3):
        rows.append((k, int(m.mask.sum()), bool(((m.w != 0) <= m.mask).all())))
        m.evolve()
    return spark.createDataFrame(rows, "step int, n int, masked boolean")


QUERIES = {
    "train_dense": _mlp,
    "train_vae": _vae,
    "train_wgan_gp": _wgan,
    "train_rbm": _rbm,
    "train_word2vec": _w2v,
    "train_modules": _modules,
    "word2vec_pairs": _pairs,
    "word2vec_noise": _noise,
    "initial_weights": _initial,
    "sparse_evolution": _sparse,
}
ORACLES = {
    "word2vec_pairs": r"""with w as (select doc_id, regexp_split_to_array(lower(text), '\s+') as w from documents), p as (select w, unnest(range(1, len(w) + 1)) as i from w),
 q as (select w[i] as target, unnest(list_concat(w[greatest(i-2, 1):i-1], w[i+1:i+2])) as context from p) select target, context, count(*)::bigint as n from q group by 1, 2""",
    "word2vec_noise": r"""with c as (select token, pow(count(*), 0.75) as w from (select unnest(regexp_split_to_array(lower(text), '\s+')) as token from documents) group by 1)
 select token, round(w / sum(w) over (), 9) as p from c""",
}
