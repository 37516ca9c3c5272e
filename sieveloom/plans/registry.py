"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Keep a query under its name; without SQL it is only run and counted."""

    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded where a result leaves the engine, as sums in another order differ in their last bits."""
    fractional = {name for name, kind in df.dtypes if kind in ("double", "float")}
    return df.select(*(_round(F.col(c), digits).alias(c) if c in fractional else F.col(c) for c in df.columns))


def _round(value: Column, digits: int) -> Column:
    return F.round(value.cast("double"), digits) + F.lit(0.0)
