"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Registers a function under its name, with its SQL if it has one."""
        def put(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if sql is not None:
                self.oracles[name or f.__name__] = sql
            return f

        return put
