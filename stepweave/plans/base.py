"""Registration of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepweave.plans.fixtures import fixture, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Fixtures and driver tables by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixture(self.spark, self.sf_dir, name)


def register(name: str, query: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    """``query`` gets the inputs; ``sql`` is a SELECT over driver tables and fixtures."""
    QUERIES[name] = lambda spark, sf_dir: query(Inputs(spark, sf_dir))
    if sql:
        ORACLES[name] = oracle(sql)
