"""Reading the driver's tables and registering queries beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of one folder, read when asked for: t.orders, t['orders']."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    __getattr__ = __getitem__


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function of Tables under its own name, with the SQL that gives the same rows."""

        def add(f: Callable[[Tables], DataFrame]):
            self.queries[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add
