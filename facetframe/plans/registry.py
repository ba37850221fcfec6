"""Collects the registered queries and, where one exists, the SQL that says the same."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under its own name."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            configure(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = textwrap.dedent(sql).strip()
        return function

    return register


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Round every DOUBLE column, so that sums taken in another order compare equal."""
    columns = []
    for field in df.schema.fields:
        ref = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            ref = (F.round(ref, other.get(field.name, digits)) + F.lit(0.0)).alias(field.name)
        columns.append(ref)
    return df.select(*columns)


def r(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"
