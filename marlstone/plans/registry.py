"""The registry the driver contract reads: query name -> callable, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one folder: ``t("orders")``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put

    def on(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """As :meth:`add`, for a function of the tables."""

        def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.add(name, sql)(lambda spark, sf_dir: f(Tables(spark, sf_dir)))
            return f

        return put
