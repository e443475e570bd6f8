"""Graph queries: nations are vertices; edges follow from their keys and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.plans.common import rounded, table

#: A nation points to the next two nations of its region and to nation key + 7.
EDGES_SQL = """n as (select n_nationkey::bigint as id, n_regionkey as reg from nation), r as (select id, reg, row_number() over (partition by reg order by id) as k from n),
 e as (select a.id as src, b.id as dst, abs(a.id - b.id)::double as w from r a join r b on a.reg = b.reg and b.k - a.k in (1, 2)
 union all select id, id + 7, 0.5::double from n where id + 7 < 25)"""
PATHS_SQL = f"""with recursive {EDGES_SQL}, p(pos, path, w) as (select 0::bigint, [0::bigint], 0.0::double union all
 select dst, list_append(path, dst), p.w + e.w from p join e on p.pos = e.src where not list_contains(path, dst) and p.pos <> 21)"""


def graph(spark, sf) -> G.Graph:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_regionkey").alias("reg"))
    from pyspark.sql import Window as W

    r = n.withColumn("k", F.row_number().over(W.partitionBy("reg").orderBy("id")))
    a, b = (r.select(F.col("id").alias(x), "reg", F.col("k").alias(f"k_{x}")) for x in ("src", "dst"))
    e = a.join(b, "reg").where("k_dst - k_src in (1, 2)").select("src", "dst", F.abs(F.col("src") - F.col("dst")).cast("double").alias("w"))
    jump = n.where("id + 7 < 25").select(F.col("id").alias("src"), (F.col("id") + 7).alias("dst"), F.lit(0.5).alias("w"))
    return G.Graph(n.select("id"), e.unionByName(jump).checkpoint())


def _all_paths(spark, sf):
    return graph(spark, sf).all_paths(0, 21).select(F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"), "w")


def _path_exists(spark, sf):
    g = graph(spark, sf)
    return spark.createDataFrame([(a, b, g.path_exists(a, b)) for a, b in ((0, 21), (21, 0))], "src bigint, dst bigint, found boolean")


def _acyclic(spark, sf):
    g = graph(spark, sf)
    both = G.Graph.undirected(g.vertices, g.edges)
    return spark.createDataFrame([("directed", g.is_acyclic()), ("undirected", both.is_acyclic())], "kind string, acyclic boolean")


def _random(acyclic):
    def run(spark, sf):
        g = G.random_graph(spark, 30, 0.3, seed=5, acyclic=acyclic)
        return g.edges.agg(F.count("*").alias("n"), F.bool_or(F.col("src") == F.col("dst")).alias("loops"), F.bool_and(F.col("src") < F.col("dst")).alias("upwards"))

    return run


QUERIES = {
    "graph_edges": lambda s, d: graph(s, d).matrix(),
    "graph_reverse": lambda s, d: graph(s, d).reverse().matrix(),
    "graph_undirected": lambda s, d: G.Graph.undirected(graph(s, d).vertices, graph(s, d).edges).matrix(),
    "graph_index": lambda s, d: graph(s, d).indexed(),
    "graph_neighbors": lambda s, d: graph(s, d).neighbors().select("src", F.array_join(F.col("dst").cast("array<string>"), ",").alias("dst")),
    "graph_all_paths": _all_paths,
    "graph_path_cost": lambda s, d: _all_paths(s, d).agg(F.count("*").alias("n"), rounded(F.min("w"), 3).alias("least"), rounded(F.max("w"), 3).alias("most")),
    "graph_reachable": lambda s, d: graph(s, d).reachable(0).select("id"),
    "graph_path_exists": _path_exists,
    "graph_levels": lambda s, d: graph(s, d).levels(),
    "graph_topological_ordering": lambda s, d: graph(s, d).topological_ordering(),
    "graph_is_acyclic": _acyclic,
    "random_graph": _random(False),
    "random_dag": _random(True),
}
_LEVELS = f"""with recursive {EDGES_SQL}, p(pos, len) as (select id, 0 from n union select dst, len + 1 from p join e on p.pos = e.src) select pos as id, max(len)::int as level from p group by 1"""
ORACLES = {
    "graph_edges": f"with {EDGES_SQL} select src, dst, sum(w) as w from e group by 1, 2",
    "graph_reverse": f"with {EDGES_SQL} select dst as src, src as dst, sum(w) as w from e group by 1, 2",
    "graph_undirected": f"with {EDGES_SQL}, u as (select src, dst, w from e union select dst, src, w from e) select src, dst, sum(w) as w from u group by 1, 2",
    "graph_index": "select n_nationkey::bigint as id, (row_number() over (order by n_nationkey) - 1)::bigint as idx from nation",
    "graph_neighbors": f"with {EDGES_SQL} select src, string_agg(dst::varchar, ',' order by dst) as dst from (select distinct src, dst from e) group by 1",
    "graph_all_paths": f"{PATHS_SQL} select array_to_string(path, '>') as path, w from p where pos = 21",
    "graph_path_cost": f"{PATHS_SQL} select count(*)::bigint as n, round(min(w), 3) as least, round(max(w), 3) as most from p where pos = 21",
    "graph_reachable": f"with recursive {EDGES_SQL}, p(pos) as (select 0::bigint union select dst from p join e on p.pos = e.src) select pos as id from p",
    "graph_path_exists": f"""with recursive {EDGES_SQL}, p(a, pos) as (select unnest([0, 21])::bigint, unnest([0, 21])::bigint union select a, dst from p join e on p.pos = e.src)
 select 0::bigint as src, 21::bigint as dst, exists (select 1 from p where a = 0 and pos = 21) as found union all select 21, 0, exists (select 1 from p where a = 21 and pos = 0)""",
    "graph_levels": _LEVELS,
    "graph_topological_ordering": _LEVELS,
    "graph_is_acyclic": f"""with recursive {EDGES_SQL}, p(a, pos) as (select src, dst from e union select a, dst from p join e on p.pos = e.src)
 select 'directed' as kind, not exists (select 1 from p where a = pos) as acyclic union all select 'undirected', not exists (select 1 from e)""",
}
