"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import queries as q

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: f for name, f in vars(q).items() if callable(f) and name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
