"""All registered queries, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from types import FunctionType

from pyspark.sql import DataFrame, SparkSession

from . import conversions, queries, training  # noqa: F401  training registers beside conversions
from .oracle import SQL as OWN_SQL

FLAGSHIP = "metrics_quality_noul"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    n: f for n, f in vars(queries).items() if isinstance(f, FunctionType) and f.__module__ == queries.__name__ and not n.startswith("_")
} | conversions.QUERIES
SQL: dict[str, str] = OWN_SQL | conversions.SQL

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
