"""Every query of the engine by name, and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliary.plans import conformance, documents, packages, reviews, structure

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (documents, structure, conformance, reviews, packages)


def queries() -> dict[str, Query]:
    return {f.__name__: f for group in GROUPS for f in group.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}
