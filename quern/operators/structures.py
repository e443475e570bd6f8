"""Priority queues and ball trees as tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import vector as X


@dataclass(frozen=True)
class PriorityQueue:
    """Entries (entry, priority) that come out by priority, ties by entry. largest_first: the order. capacity: how
    many entries a queue holds at most; pushing more lets the last ones in order go, None keeps all."""

    entries: DataFrame
    largest_first: bool = True
    capacity: int | None = None

    def _order(self) -> list[Column]:
        return [F.desc("priority") if self.largest_first else F.asc("priority"), F.asc("entry")]

    def push(self, more: DataFrame) -> PriorityQueue:
        both = self.entries.unionByName(more.select("entry", "priority"))
        return replace(self, entries=both if self.capacity is None else both.orderBy(*self._order()).limit(self.capacity))

    def peek(self, n: int = 1) -> DataFrame:
        """The first n entries with their rank from 1; each task keeps its own first n before they meet."""
        first = self.entries.where("priority is not null").orderBy(*self._order()).limit(n)
        return first.withColumn("rank", F.row_number().over(W.orderBy(*self._order())))  # n rows

    def pop(self, n: int = 1) -> tuple[DataFrame, PriorityQueue]:
        """The first n entries, and the queue without them."""
        out = self.peek(n).checkpoint()
        gone = out.select(F.col("entry").alias("_e"), F.col("priority").alias("_p"), "rank")
        nth = W.partitionBy("entry", "priority").orderBy(F.lit(1))
        times = gone.groupBy("_e", "_p").agg(F.count("*").alias("_n"))
        rest = self.entries.withColumn("_k", F.row_number().over(nth)).join(F.broadcast(times), (F.col("entry") == F.col("_e")) & (F.col("priority") == F.col("_p")), "left")
        return out, replace(self, entries=rest.where("_n is null or _k > _n").select("entry", "priority"))


@dataclass
class BallTree:
    """Exact nearest neighbours by balls around the leaves of a tree of splits.

    Splits halve a bounded sample along its widest dimension until a leaf would hold leaf_size rows of the table,
    or there are most_leaves leaves; every row then falls into a leaf, whose centre and radius are exact. A query
    needs only leaves that may hold a row as near as the k-th nearest must be, which follows from the balls alone.
    """

    leaf_size: int = 512
    most_leaves: int = 256
    sample: int = 10_000
    rows: DataFrame | None = None
    leaves: DataFrame | None = None

    def fit(self, train: DataFrame) -> BallTree:
        """train: (id, x, y). Rows with a null x are left out; vectors have one length."""
        train = train.where("x is not null")
        n = train.count()
        some = train.select("id", "x").orderBy(F.xxhash64("id"), "id").limit(self.sample).collect()
        leaves = max(1, min(self.most_leaves, n // self.leaf_size))
        leaf = self._split(np.array([r["x"] for r in some], dtype=float), leaves, [0]) if some else F.lit(0)
        self.rows = train.withColumn("leaf", leaf).checkpoint()
        long = self.rows.select("leaf", F.posexplode("x").alias("k", "v")).groupBy("leaf", "k").agg(F.avg("v").alias("m"))
        centre = long.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centre"))
        apart = self.rows.join(F.broadcast(centre), "leaf").withColumn("d", X.euclidean(F.col("x"), F.col("centre")))
        balls = apart.groupBy("leaf").agg(F.max("d").alias("radius"), F.count("*").alias("n"))
        self.leaves = centre.join(balls, "leaf").checkpoint()  # most_leaves rows at most
        return self

    def _split(self, x: np.ndarray, leaves: int, number: list[int]) -> Column:
        """The number of a row's leaf, as nested conditions."""
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(1)
        if leaves < 2 or len(x) < 2 or not spread.max() > 0:
            number[0] += 1
            return F.lit(number[0] - 1)
        k = int(np.argmax(spread))
        at = float(np.median(x[:, k]))
        low = x[:, k] <= at
        if low.all():
            at = float(np.nextafter(at, -np.inf))
            low = x[:, k] <= at
        return F.when(F.get("x", F.lit(k)) <= at, self._split(x[low], leaves // 2, number)).otherwise(self._split(x[~low], leaves - leaves // 2, number))

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """Rows (q, id, y, dist, rank) of the k closest rows of each query (q, qx), ties by id."""
        d = X.euclidean(F.col("qx"), F.col("centre"))
        near = queries.where("qx is not null").crossJoin(F.broadcast(self.leaves)).select("q", "qx", "leaf", "n", (d - F.col("radius")).alias("least"), (d + F.col("radius")).alias("most"))
        # the balls whose far sides are closest hold k rows between them: no k-th neighbour is farther
        held = F.sum("n").over(W.partitionBy("q").orderBy("most", "leaf"))
        bound = near.withColumn("held", held).groupBy("q").agg(F.coalesce(F.min(F.when(F.col("held") >= k, F.col("most"))), F.max("most")).alias("bound"))
        wanted = near.join(bound, "q").where(F.col("least") <= F.col("bound") * (1 + 1e-12) + 1e-12).select("q", "qx", "leaf")
        dist = wanted.join(self.rows, "leaf").select("q", "id", "y", "leaf", X.euclidean(F.col("x"), F.col("qx")).alias("dist"))
        own = dist.withColumn("rank", F.row_number().over(W.partitionBy("q", "leaf").orderBy("dist", "id"))).where(F.col("rank") <= k).drop("rank", "leaf")
        return own.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("dist", "id"))).where(F.col("rank") <= k)
