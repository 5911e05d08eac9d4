"""Where the plan modules register their queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from almanac.plans.fixtures import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, needs: tuple[str, ...] | list[str] = (), extra: dict[str, str] | None = None):
    """Register ``fn(tables)`` under ``name``, with the oracle ``body`` over the CTEs it ``needs``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if body is not None:
            ORACLES[name] = with_ctes(list(needs), body, extra)
        return fn

    return register


def load_all() -> None:
    from almanac.plans import arrivals, conform, documents, ops, routing, star  # noqa: F401
