"""The query catalogue: every operator over the fixture tables, next to an independent SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; ``sql`` is the twin, if plain SQL can say it."""

    def register(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    from newsloom.plans import (  # noqa: F401
        catalog_clean,
        catalog_digest,
        catalog_search,
        catalog_serving,
        catalog_sources,
        catalog_streams,
        catalog_tables,
        catalog_vectors,
    )
