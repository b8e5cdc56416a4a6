"""The registry the driver reads: a Spark query and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None, heavy: bool = False,
          shares: int = 1):
    """Register ``fn(v: Views) -> DataFrame`` under ``name``; ``sql`` uses `{view}` names.

    ``heavy`` marks work that costs much per row; ``shares``: tasks a read split is dealt into, where a row costs so much
    that a split of narrow rows is hours of work (see `Views`).
    """

    def register(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir, heavy, shares))
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return register
