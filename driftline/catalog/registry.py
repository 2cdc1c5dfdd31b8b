"""The named queries, each with the SQL that checks it.

Every query runs over whole tables. Where the tables lack a state that an operator needs (which files the target misses,
which policies are submitted anew, which runs are closed), a condition such as ``key % 5 = 0`` plays its part; it decides
what a row is, not how many rows are worked on.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from driftline.sources.views import table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = datetime(2001, 9, 1)


class Data:
    """Tables and views of one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``run(data)`` under ``name``; ``sql`` may use the named views."""

    def register(run: Callable[[Data], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(Data(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return run

    return register
