"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleanframe.plans import changes, ranking, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**texts.QUERIES, **ranking.QUERIES, **changes.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**texts.SQL, **ranking.SQL, **changes.SQL}
