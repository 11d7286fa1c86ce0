"""Registered queries: a function of the tables, and its SQL if it has any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.session import ship


class Tables:
    """Tables of a folder by name, as attributes or items."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            def run(spark: SparkSession, folder: str) -> DataFrame:
                ship(spark)
                return f(Tables(spark, folder))

            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return add

    def update(self, other: Registry) -> None:
        self.queries.update(other.queries)
        self.sql.update(other.sql)
