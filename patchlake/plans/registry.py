"""Every registered query with its SQL equivalent."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "o68_image_eval"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name; sql gives the same rows (None: tests hold it against brute force)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name in ("scalars", "search", "evaluation", "banks", "stores", "masks", "catalog", "upkeep", "assembled", "kept"):
    importlib.import_module(f"patchlake.plans.{_name}")
