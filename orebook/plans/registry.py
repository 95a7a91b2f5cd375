"""The registry: a key, a Spark plan over the given tables and, where it exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orebook.session import configure
from orebook.sources.tables import Tables

PLANS: dict[str, Callable[[Tables], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        if key in PLANS:
            raise ValueError(f"{key} is registered twice")
        PLANS[key] = fn
        if sql is not None:
            TWINS[key] = sql.strip()
        return fn

    return add


def runnable(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(Tables(configure(spark), folder))

    return run
