"""Registered analytics queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scoreloom.plans import league_queries, model_queries, panel_queries, read_queries, value_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = [panel_queries, league_queries, model_queries, read_queries, value_queries]


def queries() -> dict[str, Query]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
