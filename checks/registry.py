"""Name, Spark query and oracle of every check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(sql: str, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with the SQL it must equal."""

    def register(query: Query) -> Query:
        key = name or query.__name__
        QUERIES[key] = query
        ORACLES[key] = sql
        return query

    return register


def as_ms(column: str, alias: str) -> Column:
    return F.unix_millis(F.col(column)).alias(alias)


def as_us(column: str, alias: str) -> Column:
    return F.unix_micros(F.col(column)).alias(alias)


BYTE_COLUMNS = ("ingress_bytes", "egress_bytes")


def fact_rows(facts: DataFrame, *more: str) -> DataFrame:
    return facts.select(as_ms("bucket", "bucket_ms"), "identity_id", "scope", *BYTE_COLUMNS, *more)
