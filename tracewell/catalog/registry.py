"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.session import configure, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """The given tables of one directory, by attribute."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)


def query(name: str, sql: str | None = None):
    """Register ``build(inputs) -> DataFrame`` under a name, with its SQL if there is one."""

    def register(build):
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(Inputs(configure(spark), directory))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
