"""Registered queries: one per operator of the survey inventory, each ``(spark, sf_dir) -> DataFrame``,
with the DuckDB SQL that must return the same rows (absent for model and text jobs).

Every query runs over the whole given tables (through the fixture views), never a subset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (each registers itself)."""
    import importlib
    for mod in PLAN_MODULES:
        importlib.import_module(f"contrail.plans.{mod}")


PLAN_MODULES = ["rates", "time", "legs", "evaluation", "explain", "models", "io"]
