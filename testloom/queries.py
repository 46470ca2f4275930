"""Registered queries of the test-results operators, each with DuckDB SQL for its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from testloom.plans import bazel_queries, ci_queries, owner_queries, retry_queries, run_queries, source_queries, validation_queries
from testloom.plans.registry import QUERIES, SQL

MODULES = (retry_queries, run_queries, validation_queries, ci_queries, bazel_queries, owner_queries, source_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
