"""Registry of queries: a name, a Spark function and, where SQL can say it, the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog, open_catalog

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Catalog], DataFrame]], Callable[[Catalog], DataFrame]]:
        """Register a function of a catalog under its own (or another) name."""

        def register(build: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
            key = name or build.__name__
            self.queries[key] = lambda spark, sf_dir: build(open_catalog(spark, sf_dir))
            if sql:
                self.sql[key] = sql
            return build

        return register
