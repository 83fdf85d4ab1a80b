"""All registered queries and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("words", "social", "web", "positions", "graph", "streams", "files")


def _modules():
    return [import_module(f"tidemark.plans.{name}") for name in FAMILIES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query for module in _modules() for key, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in _modules() for key, sql in module.ORACLES.items()}
