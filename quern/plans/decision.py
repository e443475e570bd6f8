"""Decision queries: events are pulls (arm: type, reward: value / 100) and steps of users' episodes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import bandits as B
from quern.operators import reinforcement as R
from quern.operators import vocabulary as V
from quern.plans import graph as G
from quern.plans.common import rounded, table


def _log(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("arm"), (F.col("value") / 100).alias("reward"))
    return e.withColumn("t", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))


def _running(spark, sf):
    out = B.running(_log(spark, sf), "arm", "reward", ["t"], ["user_id"])
    return out.select("event_id", "n", rounded("mean", 9).alias("mean"), rounded(B.ucb1(F.col("mean"), F.col("n"), F.col("t")), 9).alias("ucb"))


def _greedy(spark, sf):
    """The arm with the best mean of each user's log; ties go to the first name. Means are ranked as they are, in one
    pass: a sum of doubles that is made twice, to be joined by equality, may differ in its last bits."""
    own = _log(spark, sf).groupBy("user_id", "arm").agg(F.avg("reward").alias("mean"))
    best = W.partitionBy("user_id").orderBy(F.desc_nulls_last("mean"), F.asc_nulls_last("arm"))
    return own.withColumn("k", F.row_number().over(best)).where("k = 1").select("user_id", "arm")


def _posterior(spark, sf):
    out = B.beta_posterior(_log(spark, sf), "arm", F.col("reward") > 0.5)
    return out.select("arm", "alpha", "beta", rounded("map").alias("map"))


def _linucb(spark, sf):
    x = [F.lit(1.0), F.col("t") / 10.0, (F.col("user_id") % 7) / 7.0]
    out = B.linucb_statistics(_log(spark, sf), "arm", x, F.col("reward"))
    return out.select("arm", *(rounded(c, 4).alias(c) for c in out.columns if c != "arm"))


def _evs(spark, sf):
    """Values of arms whose payoffs are prices and whose probabilities are shares of their brand."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("arm"), F.col("p_retailprice").alias("payoff"))
    n = p.groupBy("arm").agg(F.count("*").alias("n"))
    return B.expected_values(p.join(n, "arm").withColumn("prob", 1.0 / F.col("n"))).select("arm", rounded("ev", 7).alias("ev"))


def _path_bandit(spark, sf):
    paths = G.graph(spark, sf).all_paths(0, 14)
    return paths.select(F.array_join(paths["path"].cast("array<string>"), ">").alias("arm"), (-F.col("w")).alias("ev"))


def _regret(spark, sf):
    log = _log(spark, sf).select(F.lit("log").alias("policy"), F.col("user_id").alias("dup"), F.col("t").alias("trial"), "event_id", "reward")
    best = table(spark, sf, "events").groupBy("event_type").agg((F.avg("value") / 100).alias("m")).agg(F.max("m").alias("oracle"))
    out = B.regret(log.crossJoin(F.broadcast(best)))
    return out.select("event_id", rounded("regret", 5).alias("regret"), rounded("cumulative", 5).alias("cumulative"))


def _mse(spark, sf):
    own = _log(spark, sf).groupBy("user_id", "arm").agg(F.avg("reward").alias("mean"))
    true = _log(spark, sf).groupBy("arm").agg(F.avg("reward").alias("ev"))
    return own.join(F.broadcast(true), "arm").groupBy("user_id").agg(rounded(F.avg(F.pow(F.col("mean") - F.col("ev"), 2))).alias("mse"))


def _smooth(spark, sf):
    e = _log(spark, sf).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t", "reward"))).alias("e"))
    s = e.select("user_id", F.posexplode(B.smoothed(F.transform("e", lambda v: v["reward"]), 0.937)).alias("t", "v"))
    return s.select("user_id", "t", rounded("v", 8).alias("v"))


def _simulated(spark, sf):
    p = {"epsilon_greedy": B.Policy("epsilon_greedy", 0.1), "ucb1": B.Policy("ucb1", 1.0), "thompson": B.Policy("thompson", 1.0)}
    log = B.regret(B.BanditTrainer(p).compare(spark, B.Bandit("bernoulli", probs=[0.2, 0.5, 0.8]), 200, 3))
    return log.groupBy("policy").agg(F.count("*").alias("n"), F.avg("reward").alias("reward"), F.max("cumulative").alias("regret"))


def _simulated_kinds(spark, sf):
    import numpy as np

    kinds = {
        "multinomial": B.Bandit("multinomial", [[0, 1], [0, 2]], [[0.5, 0.5], [0.4, 0.6]]), "gaussian": B.Bandit("gaussian", [(0.5, 0.1), (1.0, 0.1)], [0.9, 0.8]),
        "contextual": B.Bandit("contextual", probs=[[0.9, 0.1], [0.1, 0.9]]), "linear": B.Bandit("linear", theta=np.array([[1.0, -1.0], [0.5, 0.5]])),
    }
    out = None
    for k, b in kinds.items():
        policy = B.Policy("linucb", 1.0) if k in ("contextual", "linear") else B.Policy("epsilon_greedy", 0.1)
        log = B.BanditTrainer({k: policy}).compare(spark, b, 100, 2).groupBy("policy").agg(F.count("*").alias("n"), F.avg("reward").alias("reward"), F.avg("oracle").alias("oracle"))
        out = log if out is None else out.unionByName(log)
    return out


def transitions(spark, sf):
    """States are event types, actions tenths of the value, rewards the value in hundreds."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.col("user_id").alias("episode"), F.row_number().over(w).alias("t"), F.col("event_type").alias("s"), F.floor(F.col("value") / 25).alias("a"),
        F.round(F.col("value") / 100, 1).alias("r"), F.lead("event_type").over(w).alias("s2"),
    )


def _model(spark, sf):
    return R.EnvModel.fit(transitions(spark, sf))


def _probs(spark, sf):
    return _model(spark, sf).outcome_probs().select("s", "a", "r", "s2", rounded("p").alias("p"))


def _sweep(spark, sf):
    m = _model(spark, sf)
    q = m.state_action_pairs().withColumn("q", F.col("a").cast("double"))
    return m.sweep(q).select("s", "a", rounded("q", 9).alias("q"), rounded("priority", 9).alias("priority"))


def _values(spark, sf):
    return R.first_visit_values(transitions(spark, sf), 0.9).select("s", "a", rounded("q", 9).alias("q"), "n")


def _returns(spark, sf):
    return R.returns(transitions(spark, sf)).select("event_id", rounded("g", 4).alias("g"))


def _td(spark, sf):
    """One update of the values a / 10 by every logged step."""
    q = F.col("a") / 10.0
    return transitions(spark, sf).select("event_id", rounded(R.td_step(q, F.col("r"), F.when(F.col("s2").isNotNull(), 0.4))).alias("q"))


def _td_episodes(spark, sf):
    return R.q_learning_episodes(transitions(spark, sf)).select("episode", "s", rounded("v").alias("v"))


def _elite(spark, sf):
    o = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") * 37 % 1009).alias("reward"))
    out = R.elite(o, ["size", "price"], "reward", 200, "p_partkey")
    return out.select(*(rounded(c, 4).alias(c) for c in out.columns))


def _tiles(wrap):
    def run(spark, sf):
        e = table(spark, sf, "events").select("event_id", F.explode(R.tiles([F.col("value") / 10, F.col("user_id") / 7], 8, wrap)).alias("c"))
        return e.select("event_id", F.array_join(F.col("c").cast("array<string>"), ",").alias("tile"))

    return run


def _tile_ids(spark, sf):
    """Dense numbers of tiles in order, as an index table gives them."""
    t = _tiles(None)(spark, sf).select(F.col("tile").alias("token"), F.lit(1).alias("count")).distinct()
    return V._ranked(t).select(F.col("token").alias("tile"), (F.col("idx") + 1).alias("id"))


def _agents(spark, sf):
    agents = {
        "monte_carlo": R.Agent("monte_carlo"), "monte_carlo_off": R.Agent("monte_carlo", True), "sarsa": R.Agent("td"), "q_learning": R.Agent("td", True),
        "dyna": R.Agent("dyna"), "cross_entropy": R.Agent("cross_entropy"),
    }
    log = R.train_agents(spark, agents, R.GridWorld(3), 60)
    return log.groupBy("agent", "seed").agg(F.count("*").alias("n"), F.avg("reward").alias("reward"), F.max("greedy").alias("greedy"))


LOG = "l as (select event_id, user_id, event_type as arm, value / 100 as reward, row_number() over (partition by user_id order by ts, event_id) as t from events)"
TR = """tr as (select event_id, user_id as episode, row_number() over w as t, event_type as s, floor(value / 25)::bigint as a, round(value / 100, 1) as r, lead(event_type) over w as s2
 from events window w as (partition by user_id order by ts, event_id))"""
MODEL = f"{TR}, m as (select s, a, r, s2, count(*)::bigint as n from tr where s2 is not null group by all), p as (select *, n::double / sum(n) over (partition by s, a) as p from m)"
_TILE = "t.t::varchar || ',' || {0} || ',' || {1}"
_T8 = "(select unnest(range(0, 8)) as t) t"
_FLOOR = ["floor((floor(value / 10 * 8) + t * 1 % 8) / 8.0::double)::bigint", "floor((floor(user_id / 7.0::double * 8) + t * 3 % 8) / 8.0::double)::bigint"]

QUERIES = {
    "bandit_running": _running,
    "bandit_greedy": _greedy,
    "bandit_posterior": _posterior,
    "bandit_linucb": _linucb,
    "bandit_expected_values": _evs,
    "bandit_shortest_path": _path_bandit,
    "bandit_regret": _regret,
    "bandit_mse": _mse,
    "bandit_smooth": _smooth,
    "bandit_simulation": _simulated,
    "bandit_kinds": _simulated_kinds,
    "env_model": lambda s, d: _model(s, d).counts,
    "env_state_actions": lambda s, d: _model(s, d).state_action_pairs(),
    "env_outcomes": lambda s, d: _model(s, d).reward_outcome_pairs("click", 1),
    "env_outcome_probs": _probs,
    "env_leading_to": lambda s, d: _model(s, d).pairs_leading_to("click"),
    "dyna_sweep": _sweep,
    "value_iteration": lambda s, d: _model(s, d).value_iteration(rounds=3).select("s", "a", rounded("q", 9).alias("q")),
    "mc_returns": _returns,
    "mc_first_visit": _values,
    "td_step": _td,
    "td_episodes": _td_episodes,
    "cem_elite": _elite,
    "tiles": _tiles(None),
    "tiles_wrap": _tiles([4, 5]),
    "tile_ids": _tile_ids,
    "rl_agents": _agents,
}
ORACLES = {
    "bandit_running": f"""with {LOG}, r as (select event_id, t, count(*) over w as n, avg(reward) over w as mean from l window w as (partition by user_id, arm order by t rows unbounded preceding))
 select event_id, n::bigint as n, round(mean, 9) as mean, round(mean + sqrt(ln(t) / n), 9) as ucb from r""",
    "bandit_greedy": f"with {LOG}, m as (select user_id, arm, avg(reward) as mean from l group by 1, 2) select user_id, arm from (select *, row_number() over (partition by user_id order by mean desc, arm) as k from m) where k = 1",
    "bandit_posterior": f"with {LOG}, p as (select arm, sum((reward > 0.5)::int)::double + 1 as alpha, sum((reward <= 0.5)::int)::double + 1 as beta from l group by 1) select arm, alpha, beta, round((alpha - 1) / (alpha + beta - 2), 6) as map from p",
    "bandit_linucb": f"with {LOG}, x as (select arm, reward, 1.0::double as x0, t / 10.0::double as x1, user_id % 7 / 7.0::double as x2 from l) select arm, "
    + ", ".join([f"round(sum(x{i} * x{j}) + {float(i == j)}, 4) + 0.0 as a_{i}_{j}" for i in range(3) for j in range(i, 3)] + [f"round(sum(reward * x{i}), 4) + 0.0 as b_{i}" for i in range(3)]) + " from x group by 1",
    "bandit_expected_values": "select p_brand as arm, round(avg(p_retailprice), 7) as ev from part group by 1",
    "bandit_shortest_path": G.PATHS_SQL.replace("p.pos <> 21", "p.pos <> 14") + " select array_to_string(path, '>') as arm, -w as ev from p where pos = 14",
    "bandit_regret": f"""with {LOG}, o as (select max(m) as oracle from (select avg(value) / 100 as m from events group by event_type))
 select event_id, round(oracle - reward, 5) + 0.0 as regret, round(sum(oracle - reward) over (partition by user_id order by t rows unbounded preceding), 5) + 0.0 as cumulative from l, o""",
    "bandit_mse": f"""with {LOG}, m as (select user_id, arm, avg(reward) as mean from l group by 1, 2), e as (select arm, avg(reward) as ev from l group by 1)
 select user_id, round(avg(pow(mean - ev, 2)), 6) as mse from m join e using (arm) group by 1""",
    "bandit_smooth": f"""with recursive {LOG}, f(user_id, t, v) as (select user_id, t, reward from l where t = 1 union all select f.user_id, l.t, 0.937 * f.v + 0.063 * l.reward from f join l on l.user_id = f.user_id and l.t = f.t + 1)
 select user_id, (t - 1)::int as t, round(v, 8) + 0.0 as v from f""",
    "env_model": f"with {MODEL} select s, a, r, s2, n from m",
    "env_state_actions": f"with {MODEL} select distinct s, a from m",
    "env_outcomes": f"with {MODEL} select r, s2 from m where s = 'click' and a = 1",
    "env_outcome_probs": f"with {MODEL} select s, a, r, s2, round(p, 6) as p from p",
    "env_leading_to": f"with {MODEL} select distinct s, a from m where s2 = 'click'",
    "dyna_sweep": f"with {MODEL}, b as (select s as s2, max(a)::double as best from m group by 1) select s, a, round(sum(p * (r + 0.9 * coalesce(best, 0))), 9) as q, round(abs(sum(p * (r + 0.9 * coalesce(best, 0))) - a), 9) as priority from p left join b using (s2) group by 1, 2",
    "value_iteration": f"with {MODEL}, q1 as (select s, a, sum(p * r) as q from p group by 1, 2), q2 as (select s, a, sum(p * (r + 0.9 * coalesce(best, 0))) as q from p left join (select s as s2, max(q) as best from q1 group by 1) using (s2) group by 1, 2) select s, a, round(sum(p * (r + 0.9 * coalesce(best, 0))), 9) as q from p left join (select s as s2, max(q) as best from q2 group by 1) using (s2) group by 1, 2",
    "mc_returns": f"with {TR} select event_id, round(sum(r) over (partition by episode order by t rows between current row and unbounded following), 4) + 0.0 as g from tr",
    "mc_first_visit": f"""with {TR}, g as (select *, sum(r * pow(0.9, t)) over (partition by episode order by t rows between current row and unbounded following) / pow(0.9, t) as g,
 row_number() over (partition by episode, s, a order by t) as k from tr) select s, a, round(avg(g), 9) as q, count(*)::bigint as n from g where k = 1 group by 1, 2""",
    "td_step": f"with {TR} select event_id, round(a / 10.0::double + 0.4 * (r + 0.99 * (case when s2 is null then 0 else 0.4 end) - a / 10.0::double), 6) + 0.0 as q from tr",
    "td_episodes": f"""with recursive {TR}, f(episode, t, m) as (select distinct episode, 0::bigint, map([]::varchar[], []::double[]) from tr union all
 select f.episode, tr.t, map_concat(f.m, map([tr.s], [coalesce(f.m[tr.s], 0) + 0.4 * (tr.r + 0.9 * coalesce(f.m[tr.s2], 0) - coalesce(f.m[tr.s], 0))])) from f join tr on tr.episode = f.episode and tr.t = f.t + 1),
 l as (select episode, arg_max(m, t) as m from f group by 1) select episode, e.k as s, round(e.v, 6) + 0.0 as v from (select episode, unnest([struct_pack(k := k, v := m[k]) for k in map_keys(m)]) as e from l)""",
    "cem_elite": """with o as (select p_size::double as size, p_retailprice as price from part order by p_partkey * 37 % 1009 desc, p_partkey limit 200)
 select round(avg(size), 4) as mean_size, round(var_pop(size), 4) as var_size, round(avg(price), 4) as mean_price, round(var_pop(price), 4) as var_price from o""",
    "tiles": f"select event_id, {_TILE.format(*_FLOOR)} as tile from events, {_T8}",
    "tiles_wrap": f"select event_id, {_TILE.format(f'(({_FLOOR[0]} % 4) + 4) % 4', f'(({_FLOOR[1]} % 5) + 5) % 5')} as tile from events, {_T8}",
    "tile_ids": f"with t as (select distinct {_TILE.format(*_FLOOR)} as tile from events, {_T8}) select tile, row_number() over (order by tile)::bigint as id from t",
}
