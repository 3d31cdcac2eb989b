"""Queries and their SQL, kept side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """longs: columns that SQL counts as long integers where Spark has int."""

        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = f if not longs else lambda spark, d: f(spark, d).withColumns({c: F.col(c).cast("long") for c in longs})
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
