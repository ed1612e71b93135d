"""The registered queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from murmurlake.plans import cadence, compare, graphs, replies, review, words

FLAGSHIP = "cadence_hourly"
PLANS = (cadence, replies, words, compare, graphs, review)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for plan in PLANS for name, text in plan.SQL.items()}
