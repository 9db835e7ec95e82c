"""Every query of the library and its oracle, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import case_queries, explicit_queries, gazetteer_queries, ordered_queries, policy_queries, quasi_queries, recognizer_queries, run_queries

_ALL = explicit_queries.REGISTRY | quasi_queries.REGISTRY | policy_queries.REGISTRY | case_queries.REGISTRY | recognizer_queries.REGISTRY | gazetteer_queries.REGISTRY | ordered_queries.REGISTRY | run_queries.REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: found[0] for name, found in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: found[1] for name, found in _ALL.items() if found[1]}
