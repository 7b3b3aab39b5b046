"""Registered queries over the test tables, each next to its reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IDS: dict[str, list[str]] = {}
MODULES = ["shaping", "joining", "aggregating", "ordering", "features", "states", "statistics", "learning", "landing", "live"]


def register(ids: str, sql: str | None = None):
    """Register a query under its function name; ``ids`` are inventory ids it covers."""

    def keep(function):
        name = function.__name__
        QUERIES[name] = function
        IDS[name] = ids.split()
        if sql:
            SQL[name] = sql
        return function

    return keep


def load() -> None:
    for module in MODULES:
        import_module(f"pitchframe.suite.{module}")
