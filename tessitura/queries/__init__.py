"""Registered queries and the SQL that must agree with them, one module per family."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ("segments", "transcripts", "audit", "spans", "lyrics", "signals", "gate", "lineage", "resolve", "live")


def all_queries() -> dict[str, Query]:
    """Every registered query by name."""
    found: dict[str, Query] = {}
    for family in FAMILIES:
        found.update(import_module(f"tessitura.queries.{family}").QUERIES)
    return found


def all_oracles() -> dict[str, str]:
    """DuckDB SQL per query name, where SQL can express it."""
    found: dict[str, str] = {}
    for family in FAMILIES:
        found.update(import_module(f"tessitura.queries.{family}").ORACLES)
    return found
