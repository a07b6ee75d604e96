"""Registered queries and, where one exists, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge import session
from tidegauge.queries.oracle_inputs import with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None, recursive: bool = False, extra: dict[str, str] | None = None):
    """Register the decorated function under its name, with its SQL over the input tables."""

    def add(function):
        name = function.__name__.strip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(session.prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_inputs(sql, recursive, extra)
        return run

    return add


def load_all() -> None:
    from tidegauge.queries import (  # noqa: F401
        admission_queries, envelope_queries, fleet_queries, frame_queries, gossip_queries,
        packet_queries, presence_queries, profile_queries, registry_queries, rule_queries, source_queries,
        stream_queries)
