"""Where query modules register their queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from testloom.plans.adapters import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def counted(sql: str) -> str:
    """sql with count_if(x) as a filtered count, which gives a 64-bit integer."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + len("count_if("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) filter (where {sql[at + len('count_if('):end - 1]}){sql[end:]}"
    return sql


def query(name: str, views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = counted(with_views(views, sql) if views else sql)
        return f

    return add
