"""Named queries and the SQL that another engine can check them with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .session import naive, views

Query = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, folder) -> DataFrame, with SQL that gives the same rows."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = lambda spark, folder: naive(f(spark, folder))
        if sql:
            SQL[key] = sql
        return f

    return add


def shared_sql(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register a query that is SQL in both engines (`spark_sql` where Spark's dialect differs)."""
    text = spark_sql or sql
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, *used)
        return spark.sql(text)

    query(sql, name)(run)
