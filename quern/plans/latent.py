"""Mixture, sequence, topic and factor queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quern.operators import latent as L
from quern.operators import vocabulary as V
from quern.plans.common import rounded, table
from quern.plans.decision import _log


def _items(spark, sf):
    i = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("q"), (F.col("l_extendedprice") / 10_000).alias("p"), "l_discount")
    return i.withColumn("w", 1 - F.col("l_discount"))


def _m_step(spark, sf):
    out = L.m_step(_items(spark, sf), "l_returnflag", F.col("w"), ["q", "p"])
    return out.select("l_returnflag", *(rounded(c).alias(c) for c in out.columns[1:]))


def _gmm(spark, sf):
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 500.0).alias("x"))
    m = L.GMM(2).fit(x, max_iter=5)
    ok = all(b >= a - 1e-6 for a, b in zip(m.bounds, m.bounds[1:], strict=False))
    return m.predict(x).groupBy("component").agg(F.count("*").alias("n")).withColumn("bound_rises", F.lit(ok))


def _gmm_soft(spark, sf):
    """Probabilities of the components of a mixture with fixed parameters."""
    x = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size") / 10.0, F.col("p_retailprice") / 500.0).alias("x"))
    m = L.GMM(2, eps=0.0)
    m.mu, m.sigma, m.pi = np.array([[1.0, 2.0], [4.0, 3.0]]), np.array([np.eye(2), 2 * np.eye(2)]), np.array([0.4, 0.6])
    return m.predict_proba(x).select("id", "component", rounded("p", 8).alias("p"))


#: Fixed parameters: two states over the five event types in order of their names.
HMM = L.MultinomialHMM(np.array([[0.7, 0.3], [0.4, 0.6]]), np.array([[0.4, 0.3, 0.1, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]]), np.array([0.6, 0.4]))


def _sequences(spark, sf):
    """Each user's events in order, as numbers of their types."""
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(HMM.b.shape[1] + 1).collect()]
    if len(kinds) > HMM.b.shape[1]:
        raise ValueError(f"the model knows {HMM.b.shape[1]} types of events, there are more")
    own = F.array_position(F.array(*map(F.lit, kinds)), F.col("arm")).cast("int") - 1
    e = _log(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", own.alias("o")))).alias("e"))
    return e.select("user_id", F.transform("e", lambda v: v["o"]).alias("obs"))


def _forward(spark, sf):
    return _sequences(spark, sf).select("user_id", rounded(HMM.log_likelihood(F.col("obs"))).alias("log_likelihood"))


def _viterbi(spark, sf):
    v = _sequences(spark, sf).select("user_id", HMM.viterbi(F.col("obs")).alias("v"))
    return v.select("user_id", rounded("v.log_prob").alias("log_prob"), F.array_join(F.col("v.path").cast("array<string>"), "").alias("path"))


def _baum_welch(spark, sf):
    m = L.MultinomialHMM(HMM.a, HMM.b, HMM.pi)
    lls = m.fit(_sequences(spark, sf), max_iter=5)
    return spark.createDataFrame([(k, v, k == 0 or v >= lls[k - 1]) for k, v in enumerate(lls)], "round int, log_likelihood double, rises boolean")


def _hmm_generate(spark, sf):
    s, o = HMM.generate(20)
    return spark.createDataFrame(list(enumerate(zip(s, o, strict=True))), "t int, v struct<state:int,obs:int>").select("t", "v.state", "v.obs")


def _words(spark, sf):
    """Documents as numbers of their words, in the order of the words."""
    rows = V.token_rows(table(spark, sf, "documents"))
    numbers = V._ranked(V.Vocabulary.fit(rows).tokens.select("token", "count"))
    return rows.join(numbers.select("token", "idx"), "token").select(F.col("doc_id").alias("doc"), F.col("idx").cast("int").alias("word"))


def _lda(spark, sf):
    docs = _words(spark, sf).groupBy("doc").agg(F.sort_array(F.collect_list("word")).alias("words")).persist()
    size = docs.agg(F.max(F.array_max("words"))).first()[0]
    m = L.LDA(3, 0 if size is None else size + 1).train(docs, max_iter=4)
    return spark.createDataFrame([(k, float(b), k == 0 or b >= m.bounds[k - 1]) for k, b in enumerate(m.bounds)], "round int, bound double, rises boolean")


def _topic_counts(spark, sf):
    """Fixed topics: a word's topic follows from its number and the document's."""
    return _words(spark, sf).withColumn("topic", ((F.col("word") + F.col("doc")) % 4).cast("int")).groupBy("doc", "word", "topic").agg(F.count("*").alias("n"))


def _phi(spark, sf):
    return L.fit_params(_topic_counts(spark, sf), 4, 0.1, 0.01)[0].select("word", "topic", rounded("p", 8).alias("p"))


def _theta(spark, sf):
    return L.fit_params(_topic_counts(spark, sf), 4, 0.1, 0.01)[1].select("doc", "topic", rounded("p", 8).alias("p"))


def _top_words(spark, sf):
    phi = L.fit_params(_topic_counts(spark, sf), 4, 0.1, 0.01)[0].withColumn("p", rounded("p", 8))
    return L.top_words(phi, 5).select("topic", "word", "rank")


def _gibbs(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), F.explode(F.split("text", " ")).alias("w"))
    numbers = V._ranked(items.groupBy(F.col("w").alias("token")).count())
    docs = items.join(numbers.select(F.col("token").alias("w"), "idx"), "w").groupBy("doc").agg(F.sort_array(F.collect_list(F.col("idx").cast("int"))).alias("words"))
    return L.gibbs(docs, 3, numbers.count(), sweeps=2).groupBy("topic").agg(F.sum("n").alias("n"))


def _matrix(spark, sf):
    """Mean price in thousands by returned flag x quantity: a dense matrix (row, col, v)."""
    i = table(spark, sf, "lineitem").select(F.col("l_quantity").cast("int").alias("row"), F.round(F.col("l_discount") * 100).cast("int").alias("col"), (F.col("l_extendedprice") / 1000).alias("v"))
    return i.groupBy("row", "col").agg(F.avg("v").alias("v"))


def _als_half(spark, sf):
    x = _matrix(spark, sf)
    h = x.select(F.col("col").alias("id")).distinct().select("id", F.array(F.lit(1.0), F.col("id") / 10.0).alias("f"))
    return L.half_step(x, "row", "col", h, 2, 1.0).select("id", rounded(F.get("f", 0), 5).alias("f0"), rounded(F.get("f", 1), 5).alias("f1"))


def _fit(model):
    def run(spark, sf):
        m = model().fit(_matrix(spark, sf).persist())
        return spark.createDataFrame([(k, float(v), k == 0 or v <= m.losses[k - 1] * (1 + 1e-9)) for k, v in enumerate(m.losses)], "round int, loss double, falls boolean")

    return run


SEQ = """ty as (select event_type as arm, row_number() over (order by event_type) - 1 as o from (select distinct event_type from events)),
 l as (select user_id, o, row_number() over (partition by user_id order by ts, event_id) as t from events join ty on ty.arm = event_type), s as (select user_id, t, o from l),
 b(o, b0, b1) as (values (0, 0.4::double, 0.1::double), (1, 0.3, 0.1), (2, 0.1, 0.2), (3, 0.1, 0.3), (4, 0.1, 0.3)), sb as (select user_id, t, b0, b1 from s join b using (o))"""
_WORDS = """tok as (select doc_id as doc, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as token from documents), cn as (select token, count(*) as c from tok group by 1),
 id as (select token, (row_number() over (order by token) - 1)::int as word from cn), w as (select doc, word from tok join id using (token)),
 tc as (select doc, word, ((word + doc) % 4)::int as topic, count(*) as n from w group by all)"""
_PHI = f"with {_WORDS}, wt as (select word, topic, sum(n) as n from tc group by all), phi as (select word, topic, round((n + 0.01::double) / (sum(n) over (partition by topic) + (select count(distinct word) from tc) * 0.01::double), 8) as p from wt)"

QUERIES = {
    "gmm_m_step": _m_step,
    "gmm_fit": _gmm,
    "gmm_soft": _gmm_soft,
    "hmm_forward": _forward,
    "hmm_viterbi": _viterbi,
    "hmm_baum_welch": _baum_welch,
    "hmm_generate": _hmm_generate,
    "lda_train": _lda,
    "lda_phi": _phi,
    "lda_theta": _theta,
    "lda_top_words": _top_words,
    "lda_gibbs": _gibbs,
    "als_half_step": _als_half,
    "als_fit": _fit(lambda: L.ALS(2, max_iter=3)),
    "nmf_fit": _fit(lambda: L.NMF(2, max_iter=3)),
}
ORACLES = {
    "gmm_m_step": """with i as (select l_returnflag, l_quantity / 10 as q, l_extendedprice / 10000 as p, 1 - l_discount as w from lineitem),
 s as (select l_returnflag, sum(w) as n, sum(w * q) / sum(w) as mu_q, sum(w * p) / sum(w) as mu_p, sum(w * q * q) / sum(w) as qq, sum(w * p * p) / sum(w) as pp from i group by 1)
 select l_returnflag, round(n / sum(n) over (), 6) as pi, round(mu_q, 6) as mu_q, round(mu_p, 6) as mu_p, round(qq - mu_q * mu_q, 6) as var_q, round(pp - mu_p * mu_p, 6) as var_p from s""",
    "gmm_soft": """with x as (select p_partkey as id, p_size / 10.0::double as a, p_retailprice / 500.0::double as b from part),
 d as (select id, 0.4 * exp(-0.5 * (pow(a - 1, 2) + pow(b - 2, 2))) as d0, 0.6 * exp(-0.25 * (pow(a - 4, 2) + pow(b - 3, 2))) / 2 as d1 from x)
 select id, k::int as component, round((case when k = 0 then d0 else d1 end) / (d0 + d1), 8) + 0.0 as p from d, (select unnest([0, 1]) as k)""",
    "hmm_forward": f"""with recursive {SEQ}, f(user_id, t, a0, a1) as (select user_id, t, ln(0.6 * b0), ln(0.4 * b1) from sb where t = 1 union all
 select f.user_id, sb.t, ln(exp(a0 + ln(0.7)) + exp(a1 + ln(0.4))) + ln(b0), ln(exp(a0 + ln(0.3)) + exp(a1 + ln(0.6))) + ln(b1) from f join sb on sb.user_id = f.user_id and sb.t = f.t + 1)
 select user_id, round(arg_max(ln(exp(a0) + exp(a1)), t), 6) as log_likelihood from f group by 1""",
    "hmm_viterbi": f"""with recursive {SEQ}, f(user_id, t, a0, a1, p0, p1) as (select user_id, t, ln(0.6) + ln(b0), ln(0.4) + ln(b1), '0', '1' from sb where t = 1 union all
 select f.user_id, sb.t, greatest(a0 + ln(0.7), a1 + ln(0.4)) + ln(b0), greatest(a0 + ln(0.3), a1 + ln(0.6)) + ln(b1),
 (case when a0 + ln(0.7) >= a1 + ln(0.4) then p0 else p1 end) || '0', (case when a0 + ln(0.3) >= a1 + ln(0.6) then p0 else p1 end) || '1' from f join sb on sb.user_id = f.user_id and sb.t = f.t + 1),
 z as (select user_id, arg_max(a0, t) as a0, arg_max(a1, t) as a1, arg_max(p0, t) as p0, arg_max(p1, t) as p1 from f group by 1)
 select user_id, round(greatest(a0, a1), 6) as log_prob, case when a0 >= a1 then p0 else p1 end as path from z""",
    "lda_phi": f"{_PHI} select word, topic, p from phi",
    "lda_theta": f"with {_WORDS}, dt as (select doc, topic, sum(n) as n from tc group by all) select doc, topic, round((n + 0.1::double) / (sum(n) over (partition by doc) + 0.4::double), 8) as p from dt",
    "lda_top_words": f"{_PHI}, r as (select *, row_number() over (partition by topic order by p desc, word) as rank from phi) select topic, word, rank::int as rank from r where rank <= 5",
    "als_half_step": """with x as (select l_quantity::int as r, round(l_discount * 100)::int as c, avg(l_extendedprice / 1000) as v from lineitem group by 1, 2), h as (select distinct c, c / 10.0::double as h from x),
 g as (select count(*) + 1.0::double as a, sum(h) as b, sum(h * h) + 1 as d from h), s as (select r, sum(v) as b0, sum(v * c / 10.0::double) as b1 from x group by 1)
 select r as id, round((d * b0 - b * b1) / (a * d - b * b), 5) as f0, round((a * b1 - b * b0) / (a * d - b * b), 5) + 0.0 as f1 from s, g""",
}
