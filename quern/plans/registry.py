"""Collects the registered queries and their oracle SQL from the plan modules."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules of quern.plans that hold queries; each has QUERIES and ORACLES.
MODULES: tuple[str, ...] = ("text", "ngram", "vector", "linear", "signal", "features", "graph", "trees", "neural", "decision", "latent", "networks", "streams")


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    queries: dict[str, Query] = {}
    oracles: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"quern.plans.{name}")
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"{name} registers {sorted(clash)} again")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
