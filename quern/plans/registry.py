"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources import table

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of a data folder, read on demand as attributes."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def spread(self, name: str, key: str) -> DataFrame:
        """A table dealt by a key to all cores, for much work a row: a file of few row groups is read by few tasks."""
        return table(self.spark, self.sf_dir, name).repartition(4 * self.spark.sparkContext.defaultParallelism, key)

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
