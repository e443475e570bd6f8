"""Graphs as edge tables (src, dst, w)."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def undirected(cls, vertices: DataFrame, edges: DataFrame) -> Graph:
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
        return cls(vertices, edges.unionByName(back).distinct())

    def reverse(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))

    def indexed(self) -> DataFrame:
        """Vertices with their place in order (id, idx)."""
        from quern.operators.features import minibatches

        return minibatches(self.vertices, 1, "id").select("id", F.col("batch").alias("idx"))

    def neighbors(self) -> DataFrame:
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("dst"))

    def matrix(self) -> DataFrame:
        """The adjacency matrix in long form, without its zeros."""
        return self.edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def all_paths(self, start: int, end: int) -> DataFrame:
        """All simple paths from start to end (path, w), by joins of the frontier. A simple path passes each vertex
        once, so this ends; the number of paths may grow exponentially with the graph."""
        spark = self.vertices.sparkSession
        front = spark.createDataFrame([(start, [start], 0.0)], "at bigint, path array<bigint>, w double")
        found = []
        while True:
            done = front.where(F.col("at") == end)
            found.append(done.select("path", "w"))
            open_ = front.where(F.col("at") != end)
            front = (
                open_.join(self.edges.select(F.col("src").alias("at"), "dst", F.col("w").alias("_w")), "at")
                .where(~F.array_contains("path", F.col("dst")))
                .select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("w") + F.col("_w")).alias("w"))
            ).checkpoint()
            if front.isEmpty():
                break
        out = found[0]
        for f in found[1:]:
            out = out.unionByName(f)
        return out

    def reachable(self, start: int) -> DataFrame:
        """Vertices that start reaches, by frontiers (id, hops); start itself with 0."""
        spark = self.vertices.sparkSession
        seen = spark.createDataFrame([(start, 0)], "id bigint, hops int")
        front = seen.select("id")
        for hops in count(1):
            front = self.edges.join(front.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
            if front.isEmpty():
                break
            seen = seen.unionByName(front.withColumn("hops", F.lit(hops))).checkpoint()
        return seen

    def path_exists(self, start: int, end: int) -> bool:
        return not self.reachable(start).where(F.col("id") == end).isEmpty()

    def levels(self) -> DataFrame:
        """Kahn's peeling: (id, level), the length of the longest path that ends there. Vertices on or behind
        a cycle are absent."""
        left, edges, out = self.vertices.select("id"), self.edges.select("src", "dst").distinct(), None
        level = 0
        while True:
            free = left.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").checkpoint()
            if free.isEmpty():
                break
            own = free.withColumn("level", F.lit(level))
            out = own if out is None else out.unionByName(own)
            left = left.join(free, "id", "left_anti").checkpoint()
            edges = edges.join(free.withColumnRenamed("id", "src"), "src", "left_anti").checkpoint()
            level += 1
        return out if out is not None else self.vertices.select("id").limit(0).withColumn("level", F.lit(0))

    def is_acyclic(self) -> bool:
        return self.levels().count() == self.vertices.select("id").distinct().count()

    def topological_ordering(self) -> DataFrame | None:
        """(id, level) in an order in which edges point forwards, or None on a cycle."""
        return self.levels().orderBy("level", "id") if self.is_acyclic() else None


def random_graph(spark: SparkSession, n: int, p: float = 0.5, seed: int = 0, acyclic: bool = False) -> Graph:
    """Each ordered pair (acyclic: only upwards) is an edge with probability p."""
    v = spark.range(n)
    pairs = v.select(F.col("id").alias("src"), F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("dst"))
    pairs = pairs.where("src < dst" if acyclic else "src <> dst")
    u = F.pmod(F.xxhash64(F.lit(seed), "src", "dst"), F.lit(1 << 30)) / float(1 << 30)
    return Graph(v, pairs.where(u < p).withColumn("w", F.lit(1.0)))
