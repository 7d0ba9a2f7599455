"""Every query of the engine by name, with the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ingest, retrieval


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retrieval.QUERIES | ingest.QUERIES


def oracle_sql() -> dict[str, str]:
    return retrieval.SQL | ingest.SQL
