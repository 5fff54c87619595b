"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrain.plans.bindings import bind, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Inputs:
    """The tables and bindings of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return bind(self.spark, self.folder, name)


def query(name: str, sql: str | None = None):
    """Registers a function of ``Inputs`` under ``name``, with the SQL that DuckDB compares it to."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: f(Inputs(spark, folder))
        if sql is not None:
            ORACLE_SQL[name] = oracle(sql)
        return f

    return add


for _name in ("text_queries", "retrieval_queries", "rule_queries", "scoring_queries", "operation_queries", "source_queries"):
    importlib.import_module(f"lexigrain.plans.{_name}")
