"""Embedding groups against brute force."""

import math

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from quern.llm import cells as C


def brute(rows, t=0.98):
    good = {}
    for i, v, l in rows:
        if v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (np.array(v, dtype=float), l)
    links = {i: set() for i, _, _ in rows}
    for a in good:
        for b in good:
            (x, l), (y, m) = good[a], good[b]
            if a != b and l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                links[a].add(b)
    comp = {i: i for i in links}
    for _ in links:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
    return {i: (len(links[i]), comp[i]) for i in links}


def rows_of(rng):
    rows, i = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=8)
            for noise in (0, 0, 0.02, 0.06, 0.1):
                rows.append((i, (base + noise * rng.normal(size=8)).tolist(), label))
                i += 1
    rows += [(i, [2 * x for x in rows[0][1]], 0), (i + 1, rows[0][1], None), (i + 2, None, 0), (i + 3, [0.0] * 8, 0), (i + 4, [float("nan")] * 8, 0), (i + 5, [None] * 8, 0), (i + 6, [], 1), (i + 7, rows[0][1][:4], 0)]
    return rows


def test_against_brute_force(spark):
    rows = rows_of(np.random.default_rng(0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want = brute(exact)
    for args in ({}, {"per_cell": 10, "block": 8}):
        got = {r["id"]: (r["n_links"], r["component_id"]) for r in C.near_duplicate_vectors(df, **args).collect()}
        assert got == want


def by_row(rows, t=0.98):
    """What near_duplicate_vectors states for rows (id, vector, label): sorted (id, n_links, component, kept)."""
    ok = [bool(v) and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, l in rows]
    key = [(i, l, tuple(v or ())) for i, v, l in rows]
    comp, links = list(range(len(rows))), [set() for _ in rows]
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=float) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= t:
                    links[a] |= {key[b]} - {key[a]}
                    if comp[a] != comp[b]:
                        comp = [comp[a] if c == comp[b] else c for c in comp]
    least = {}
    for (i, _, _), c in zip(rows, comp, strict=True):
        least[c] = i if least.get(c) is None else least[c] if i is None else min(least[c], i)
    return sorted(((i, len(n), least[c], i is not None and i == least[c]) for (i, _, _), n, c in zip(rows, links, comp, strict=True)), key=str)


def test_repeated_and_null_ids_by_row(spark):
    rng = np.random.default_rng(2)
    a, b, c = (rng.normal(size=8).tolist() for _ in range(3))
    near = lambda v: [x * 1.5 + 0.001 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (9, c, 1), (9, c, 1), (None, near(c), 1), (None, near(c), 1), (8, near(c), 1), (None, b, 2), (None, None, 2), (5, a, None), (6, [*a, 1.0], 0), (1, a, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("c", F.lit(0))
    for args in ({}, {"per_cell": 2, "block": 2}, {"lengths": 0}):
        got = C.near_duplicate_vectors(df, **args).collect()
        assert sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == by_row(rows)
    assert C.near_duplicate_vectors(df.limit(0)).count() == 0


def test_long_vectors_and_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):  # more lengths than have centroids
        v = rng.normal(size=k + 2)
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, (2 * v).tolist(), 0)]
    long = rng.normal(size=20_000)
    rows += [(1000, long.tolist(), 0), (1001, (long + 0.01).tolist(), 0), (1002, (-long).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = C.near_duplicate_vectors(df, per_cell=1).collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == by_row(rows)


def test_one_large_class(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.lit(-1.0), F.col("id").cast("double"))).alias("embedding"), F.lit(1).alias("label"))
    got = {r["id"]: r for r in C.near_duplicate_vectors(df).collect()}
    assert all(got[k]["n_links"] == 999 and got[k]["component_id"] == 0 for k in range(0, 3000, 3)) and got[0]["kept"]


def test_links_against_sql(spark, duck):
    names = ("vec_id", "n_links", "component_id", "kept")
    want = sorted(tuple(r) for r in duck.execute(f"select {', '.join(names)} from ({C.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r[n] for n in names) for r in C.op2(spark, SF).collect()) == want
