"""Collects the queries of all operator modules, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that define QUERIES (name -> callable) and ORACLES (name -> SQL).
MODULES: tuple[str, ...] = ("operators.columns", "operators.joins", "operators.analytics", "operators.documents", "operators.retrieval", "operators.sources", "operators.gathering", "operators.fulltext", "operators.quantiser", "operators.sampling", "operators.projection", "operators.table_functions", "operators.page_fields", "streaming.registry")


def _gather(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        part = getattr(importlib.import_module(f"tidewater.{module}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"defined twice: {sorted(clash)}")
        found |= part
    return found


def queries() -> dict[str, Query]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
