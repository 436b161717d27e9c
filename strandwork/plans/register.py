"""The register of queries: a function over the projected tables, and the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwork.plans.project import Projected, needs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Projected], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Projected(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = needs(sql)
        return f

    return add
