"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut


#: Edges beyond which the smallest neighbours are written before they are joined, and up to which one task takes all.
LARGE, FEW = 2_000_000, 500_000


def _reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (u, v), and the smallest one that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, least = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while (least[a] != least[b]).any():
        low = np.minimum(least[a], least[b])
        for side in (least[a], least[b]):
            np.minimum.at(least, side, low)
        while (least[least] != least).any():
            least = least[least]
    return ids, ids[least]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(pdf["u"].to_numpy(), pdf["v"].to_numpy()) for pdf in batches if len(pdf)]
        if held:
            ids, least = _reached(*map(np.concatenate, zip(*held, strict=True)))
            yield pd.DataFrame({"id": ids, "component_id": least})

    return cut(edges.select("u", "v").coalesce(1).mapInPandas(run, "id long, component_id long"))


def _least_neighbour(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """Labels each vertex of edges (a, b) with the smallest vertex that it reaches: rows (id, component_id).

    Up to `few` different edges one task labels all, without rounds, whose many small shuffles and tasks would take
    more than the work itself. Beyond, it alternates large-star and small-star steps, which need a number of rounds
    that grows with the logarithm of the longest chain. Every step is a combinable minimum and an equi-join, so a vertex with very many
    edges is pre-aggregated before the shuffle and its join can be split. Self-loops, repeated edges and
    edges with nulls are ignored; vertices without other edges do not appear. Only one row of counts per
    round reaches the driver.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .distinct()
    )
    if (n := e.count()) <= few:
        return _in_one_task(e)
    before = None
    # a join with an aggregate of its own key cannot be split; where edges are many, the aggregate is written first
    least = (lambda x: cut(_least_neighbour(x))) if n > LARGE else _least_neighbour
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = both.join(least(both), "u").where("v > u and v <> m").select("v", F.col("m").alias("u")).distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        small = (
            down.join(least(down), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
            .select("x.v", "x.u")
            .where("v <> u")
            .distinct()
        )
        e = cut(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = e.select(F.col("u").alias("id")).distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))
