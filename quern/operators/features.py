"""Encoders and scalers of columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Standardizer:
    """z-scores with population standard deviations; a column without spread gives null."""

    columns: Sequence[str]
    with_mean: bool = True
    with_std: bool = True
    stats: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, df: DataFrame) -> Standardizer:
        row = df.agg(F.count("*").alias("n"), *(e for c in self.columns for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")))).first()
        if row["n"] < 2:
            raise ValueError("a scale needs two rows at least")
        self.stats = {c: (row[f"m_{c}"] if self.with_mean else 0.0, row[f"s_{c}"] if self.with_std else 1.0) for c in self.columns}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.try_divide(F.col(c) - m, F.lit(s)) for c, (m, s) in self.stats.items()})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, (m, s) in self.stats.items()})


@dataclass
class OneHotEncoder:
    """Indicators of categories in sorted order; an unknown label raises."""

    categories: list | None = None
    most: int = 10_000

    def fit(self, df: DataFrame, column: str) -> OneHotEncoder:
        found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(self.most + 1).collect()]
        if len(found) > self.most:
            raise ValueError(f"more than {self.most} categories")
        self.categories = sorted(found)
        return self

    def transform(self, label: Column) -> Column:
        known = F.array(*map(F.lit, self.categories))
        bad = F.raise_error(F.concat(F.lit("unknown label "), label.cast("string"))).cast("array<double>")
        return F.when(F.array_contains(known, label), F.transform(known, lambda c: (c == label).cast("double"))).otherwise(bad)

    def inverse_transform(self, indicator: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.categories)), F.array_position(indicator, 1.0).cast("int"))


def hash_bucket(feature: Column, n_dim: int) -> Column:
    """md5 of the feature as a number, modulo n_dim, folded from four hexadecimal digits at a time."""
    h = F.md5(feature.cast("binary"))
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda a, c: F.pmod(a * 65536 + c, F.lit(n_dim)))


def feature_hash(df: DataFrame, id_col: str, features: Column, n_dim: int = 256) -> DataFrame:
    """Sparse rows (id, col, value) of a map column of features; equal columns add up."""
    rows = df.select(F.col(id_col), F.explode(features).alias("feature", "value"))
    return rows.groupBy(id_col, hash_bucket(F.col("feature"), n_dim).alias("col")).agg(F.sum("value").alias("value"))


def feature_hash_dense(df: DataFrame, id_col: str, features: Column, n_dim: int = 256) -> DataFrame:
    """Rows (id, x) with an array of n_dim values."""
    pairs = feature_hash(df, id_col, features, n_dim).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    return pairs.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(n_dim - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit(0.0))).alias("x"))


def minibatches(df: DataFrame, batch_size: int, key: str, seed: int | None = None) -> DataFrame:
    """Adds batch. Unshuffled, batches follow the key; shuffled, a seeded hash of it. Rows are ranked within
    ranges of the order and shifted by the sizes of the ranges before them, so no task orders the whole table."""
    order = F.col(key).cast("double") if seed is None else F.xxhash64(F.lit(seed), F.col(key)).cast("double")
    lo, hi = (df.agg(F.min(order), F.max(order)).first() or (0.0, 1.0)) if seed is None else (-(2.0**63), 2.0**63)
    parts = 256
    part = F.least(F.floor((order - lo) / ((hi - lo) or 1.0) * parts), F.lit(parts - 1))
    inner = df.withColumn("_o", order).withColumn("_p", part)
    inner = inner.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("_o", key)) - 1)
    sizes = inner.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))  # 256 rows
    return inner.join(F.broadcast(before), "_p").withColumn("batch", F.floor((F.col("_r") + F.col("_before")) / batch_size)).drop("_o", "_p", "_r", "_before")
