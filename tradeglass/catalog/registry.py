"""Named queries over the bound tables, each with the plain SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tradeglass.catalog.binding import Bound, with_views

QUERIES: dict[str, Callable[[Bound], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORACLE_VIEWS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is its oracle in the other engine's dialect, absent when none is feasible."""
    def wrap(fn: Callable[[Bound], DataFrame]) -> Callable[[Bound], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def oracle_text(name: str) -> str:
    return with_views(ORACLES[name], "duck", ORACLE_VIEWS)
