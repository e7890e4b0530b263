"""Registered queries of the operators and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("scores", "exact", "tokens", "near", "contamination", "sharding", "spans", "passages", "whitening", "periodic")


def all_queries() -> dict[str, Query]:
    """Every query by name."""
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"tessitura.llm.queries.{name}").QUERIES)
    return found


def all_oracles() -> dict[str, str]:
    """DuckDB SQL by query name, where SQL can express it."""
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"tessitura.llm.queries.{name}").ORACLES)
    return found
