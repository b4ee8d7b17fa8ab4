"""Queries are registered with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return keep
