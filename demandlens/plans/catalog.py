"""Registry of the engine's queries and their DuckDB counterparts.

A query is a function of the domain; its SQL, if it has one, is written against the same views in another form.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from demandlens.sources.binding import Domain, with_views

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("skill_queries", "demand_queries", "report_queries", "match_queries", "text_queries", "merge_queries", "resolution_queries", "state_queries", "sink_queries", "page_queries", "profile_queries", "rule_queries", "flow_queries", "resume_queries", "backfill_queries")


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a function of the domain under a name, with the SQL that gives the same rows."""

    def wrap(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            _ORACLES[name] = with_views(sql) if views else sql
        return f

    return wrap


def _load() -> None:
    for m in _MODULES:
        import_module(f"demandlens.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
