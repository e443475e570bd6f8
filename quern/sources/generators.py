"""Seeded random tables. Every number follows from a hash of the seed and its place, so partitions do not matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def uniform(seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def _cells(spark: SparkSession, n: int, m: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("col"))


def random_tensor(spark: SparkSession, n: int, m: int, seed: int = 0, offset: int = 0) -> DataFrame:
    """(row, col, v) of uniform numbers plus an offset."""
    return _cells(spark, n, m).withColumn("v", uniform(seed, F.col("row"), F.col("col")) + offset)


def random_binary_tensor(spark: SparkSession, n: int, m: int, sparsity: float = 0.5, seed: int = 0) -> DataFrame:
    return _cells(spark, n, m).withColumn("v", (uniform(seed, F.col("row"), F.col("col")) >= sparsity).cast("double"))


def random_one_hot(spark: SparkSession, n: int, classes: int, seed: int = 0) -> DataFrame:
    hot = F.floor(uniform(seed, F.col("row")) * classes)
    return _cells(spark, n, classes).withColumn("v", (F.col("col") == hot).cast("double"))


def random_stochastic(spark: SparkSession, n: int, m: int, seed: int = 0) -> DataFrame:
    """Rows of nonnegative numbers that sum to 1."""
    raw = spark.range(n).select(F.col("id").alias("row"), F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda c: uniform(seed, F.col("id"), c)).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return raw.withColumn("total", total).select("row", F.posexplode("x").alias("col", "v"), "total").select("row", "col", (F.col("v") / F.col("total")).alias("v"))


def random_paragraph(spark: SparkSession, n_words: int, words: Sequence[str] = WORDS, seed: int = 0) -> DataFrame:
    """(pos, word)."""
    return spark.range(n_words).select(F.col("id").alias("pos"), F.element_at(F.array(*map(F.lit, words)), (F.floor(uniform(seed, F.col("id")) * len(words)) + 1).cast("int")).alias("word"))


def sample_categorical(draws: DataFrame, probs: DataFrame, seed: int = 0, replacement: bool = True, n: int = 1) -> DataFrame:
    """Categories (cat, p) for draws (draw): by the inverse of the cumulative distribution, or, without
    replacement, the n with the smallest exponential clocks."""
    from pyspark.sql import Window as W

    if replacement:
        w = W.orderBy("cat")  # one row per category
        edges = probs.withColumn("hi", F.sum("p").over(w)).withColumn("lo", F.col("hi") - F.col("p"))
        u = draws.withColumn("u", uniform(seed, F.col("draw")))
        return u.join(F.broadcast(edges), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "cat")
    clock = -F.log(1 - uniform(seed, F.col("cat"))) / F.col("p")
    return probs.where("p > 0").withColumn("k", clock).orderBy("k").limit(n).select("cat")


def is_symmetric(m: DataFrame, tol: float = 1e-8) -> bool:
    """Of (row, col, v)."""
    t = m.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("v").alias("t"))
    return m.join(t, ["row", "col"], "full").where(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("t", F.lit(0.0))) > tol).isEmpty()


def is_stochastic(m: DataFrame, tol: float = 1e-8) -> bool:
    rows = m.groupBy("row").agg(F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return rows.where((F.abs(F.col("s") - 1) > tol) | (F.col("lo") < 0) | (F.col("hi") > 1)).isEmpty()


def is_binary(m: DataFrame) -> bool:
    return m.where(~F.col("v").isin(0.0, 1.0)).isEmpty()


def is_one_hot(m: DataFrame) -> bool:
    return is_binary(m) and is_stochastic(m)
