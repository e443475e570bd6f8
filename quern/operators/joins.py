"""Joins of rows with a table that has one row for each of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_single(rows: DataFrame, single: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with single, which has one row for each value of key and comes from an aggregation by it.

    Adaptive execution splits the rows of a hot key over tasks only where either side is freshly shuffled for the
    join. An aggregate by the key is not; dealt out by a hash of the key first, which costs a shuffle of one row
    for each key, it is.
    """
    return rows.join(single.repartition(F.xxhash64(key)), key, how)
