"""The registered queries of the learner and document operators, with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans import learner_queries, text_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return learner_queries.QUERIES | text_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return learner_queries.SQL | text_queries.SQL
