"""Queries and SQL of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans import core, oracles, references

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in core.QUERIES} | {
        "p5_found": references.p5_found,
        "p5_paths": references.p5_paths,
        "p5_descendants": references.p5_descendants,
        "p6_found": references.p6_found,
        "p6_report": references.p6_report,
        "p6_keys": references.p6_keys,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
