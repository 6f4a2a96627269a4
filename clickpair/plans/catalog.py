"""Named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables.
``register`` records the callable and, where the operation is expressible in
SQL, the oracle text.  ``load_all`` imports the modules that register.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickpair.session import ship_package

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # workers must import clickpair for UDFs
            return fn(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


_MODULES = (
    "clickpair.plans.pair_queries",
    "clickpair.plans.rate_queries",
    "clickpair.plans.vector_queries",
    "clickpair.plans.edit_queries",
    "clickpair.plans.metric_queries",
    "clickpair.plans.prep_queries",
    "clickpair.plans.embed_queries",
    "clickpair.plans.ml_queries",
    "clickpair.plans.io_queries",
    "clickpair.plans.column_queries",
)


def load_all() -> None:
    import importlib
    for m in _MODULES:
        importlib.import_module(m)
