"""Near-duplicate embeddings: spherical k-means cells, and blocked cosine products within them.

Each vector is at home in the cell of its closest centroid. A vector within distance d of the boundary to
another cell is a guest there too, where d is the largest distance that two linked unit vectors can have; so
all partners of a vector are found in its home cell, exactly, and each vector's links are counted there once.
Cells are cut into blocks, and pairs of blocks are multiplied, so a task holds two blocks however large a
cell is. Equal vectors are one class with a multiplicity before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.arrow import batch_of
from quern.llm.common import cut, session, table, with_class
from quern.llm.components import connected_components


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k unit centroids (fewer if there are fewer distinct vectors) of unit vectors; empty cells are dropped."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        c = sums[norm > 1e-12] / norm[norm > 1e-12, None]
    return c


def _unit(vectors: list, dims: int) -> np.ndarray:
    x = np.array(vectors, dtype=np.float64).reshape(-1, dims)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(reps: DataFrame, centroids: dict[int, np.ndarray], distance: float) -> DataFrame:
    """Rows (rep, label, c, dims, cell, home, vec): a vector in its home cell and as a guest where it needs to
    be. Vectors of a length without centroids share one cell."""
    apart = {d: np.linalg.norm(x[:, None] - x[None], axis=2) for d, x in centroids.items()}
    schema = "rep long, label string, c long, dims int, cell int, home int, vec binary"

    def of_length(dims: int, own: pa.RecordBatch) -> pa.RecordBatch:
        x = _unit(own.column("vec").to_pylist(), dims)
        row, cell, home = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=np.int32)
        if dims in centroids:
            sim = x @ centroids[dims].T
            at = np.argmax(sim, axis=1)
            gap = sim[np.arange(len(x)), at][:, None] - sim
            row, cell = np.nonzero(gap <= distance * apart[dims][at] + 1e-9)
            home = (at[row] == cell).astype(np.int32)
        data = [v.tobytes() for v in x]
        columns = {c: own.column(c).take(pa.array(row)) for c in ("rep", "label", "c")}
        return batch_of(schema, columns | {"dims": np.full(len(row), dims), "cell": cell, "home": home, "vec": [data[r] for r in row]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims):
                yield of_length(int(d), b.filter(pa.array(dims == d)))

    return reps.select("rep", "label", "c", "vec", F.size("vec").alias("dims")).mapInArrow(run, schema)


def _centroids(reps: DataFrame, per_cell: int, sample: int, lengths: int) -> dict[int, np.ndarray]:
    """Centroids for the commonest lengths of vectors, each fitted on at most `sample` vectors or 64 MB of them."""
    counts = reps.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").limit(lengths).collect()
    out = {}
    for r in counts:
        some = reps.where(F.size("vec") == r["d"]).orderBy("f1", "f2").limit(max(1, min(sample, (64 << 20) // (8 * r["d"])))).select("vec")
        k = min(r["count"] // per_cell, sample // 4)
        if k > 1:
            out[r["d"]] = spherical_kmeans(_unit([x[0] for x in some.collect()], r["d"]), k)
    return out


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label",
    per_cell: int = 8192, sample: int = 20_000, block: int = 1024, lengths: int = 16,
) -> DataFrame:
    """Groups vectors by cosine: rows (id, n_links, component_id, kept), one for each row.

    Two vectors link if their labels (if a label column is given) are equal and not null and their cosine, in
    double precision, is at least threshold. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing; so do vectors of different lengths. n_links counts the other vectors linked
    directly, component_id is the smallest id reached, kept marks rows that have this id themselves.

    Rows that share an id but not label and vector are vectors of their own, each with its own links; rows that
    repeat all three are one vector. Vectors with a null id link like any others: their component_id is the
    smallest id reached, null if there is none, and they are not kept. Other columns are ignored; of an empty
    table there are no rows.

    Centroids are fitted on at most `sample` vectors (the first by a hash of them) or 64 MB, for the `lengths`
    commonest lengths; this is the only bounded sample here, every vector is indexed and compared. A cell holds
    about per_cell vectors up to sample / 4 cells; beyond that cells grow, and with them the work per vector.
    """
    session(vectors.sparkSession)
    distance = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    good = F.exists("vec", lambda v: v != 0) & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.withColumn("ok", F.coalesce(good & F.col("label").isNotNull(), F.lit(False)))
    # -0.0 and 0.0 hash alike
    same = F.transform("vec", lambda v: v + F.lit(0.0))
    keyed = rows.select("id", "label", "vec", "ok", F.xxhash64("label", same).alias("f1"), F.xxhash64(F.lit("second"), same, "label").alias("f2"))
    linked = keyed.where("ok")
    ids = linked.groupBy("f1", "f2", "id").agg(F.count("*").alias("n")).groupBy("f1", "f2")
    ids = ids.agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.min("id").alias("least"))
    reps = cut(ids.join(linked.groupBy("f1", "f2").agg(F.first("label").alias("label"), F.first("vec").alias("vec")), ["f1", "f2"]))
    reps = reps.withColumn("rep", F.monotonically_increasing_id())

    found = cut(_blocks(cut(_placed(reps, _centroids(reps, per_cell, sample, lengths), distance)), threshold, block))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("id", "rep")
    least = cut(reps.select("rep", "least").join(labels, "rep").groupBy("component_id").agg(F.min("least").alias("of_all")))
    named = labels.join(least, "component_id").select("rep", "of_all")
    per_class = (
        reps.select("rep", "f1", "f2", "n", "c", "least").join(links, "rep", "left").join(named, "rep", "left")
        .select("f1", "f2", F.col("n").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("of_all", "least").alias("component_id"))
    )
    columns = ["id", "n_links", "component_id"]
    out = with_class(linked.select("id", "f1", "f2"), per_class, ["f1", "f2"]).select(*columns)
    alone = keyed.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def _blocks(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (rep, links, label): what a pair of blocks finds for its home vectors, the links to others counted
    with their multiplicities, and for every linked vector the smallest one that it reaches in that pair."""
    cell = ["label", "dims", "cell"]
    near = lambda n: F.greatest(F.lit(1), F.ceil(n / block)).cast("int")
    sizes = cut(placed.groupBy(*cell).agg(near(F.sum("home")).alias("nh"), near(F.count("*")).alias("np")))
    dealt = placed.join(sizes, cell)
    part = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    base = ["rep", *cell, "c", "vec"]
    homes = dealt.where("home = 1").select(*base, F.lit(1).alias("side"), part("nh", 1).alias("i"), every("np").alias("j"))
    others = dealt.select(*base, F.lit(0).alias("side"), part("np", 2).alias("j"), every("nh").alias("i"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy() == 1
        x = np.frombuffer(b"".join(pdf["vec"]), dtype=np.float64).reshape(len(pdf), -1)
        ids, c = pdf["rep"].to_numpy(), pdf["c"].to_numpy()
        a, b = ids[side], ids[~side]
        hit = (x[side] @ x[~side].T >= threshold) & (a[:, None] != b[None])
        links = hit @ c[~side]
        la, lb = a.copy(), b.copy()
        top = np.iinfo(np.int64).max
        while hit.any():
            na = np.minimum(la, np.where(hit, lb[None], top).min(axis=1))
            nb = np.minimum(lb, np.where(hit, na[:, None], top).min(axis=0))
            if (na == la).all() and (nb == lb).all():
                break
            la, lb = na, nb
        one = pd.DataFrame({"rep": a, "links": links, "label": la})
        two = pd.DataFrame({"rep": b, "links": 0, "label": lb})
        return pd.concat([one[(one["links"] > 0)], two[two["rep"] != two["label"]]]).astype("int64")

    return homes.unionByName(others).groupBy(*cell, "i", "j").applyInPandas(run, "rep long, links long, label long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings with equal labels, by a cosine of 0.98."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: op2 in DuckDB: all pairs of a label, and what they reach.
ORACLE_SQL = """
WITH RECURSIVE vec AS (
  SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings
), good AS (
  SELECT * FROM vec WHERE label IS NOT NULL AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM vec UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), many AS (
  SELECT a AS vec_id, count(DISTINCT b) AS n FROM link GROUP BY a
)
SELECT l.vec_id, coalesce(n, 0) AS n_links, component_id, l.vec_id = component_id AS kept
FROM least l LEFT JOIN many USING (vec_id)
"""
