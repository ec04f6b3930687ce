"""Cutting long plans with written tables.

A stage is a Parquet table in a fresh shared folder.  Later steps read it
instead of repeating what made it, and a lost executor costs only its own
tasks.  Operators that use a result several times take a ``stage`` argument;
without one the plan stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from bytewake import session

Stage = Callable[[DataFrame, str], DataFrame]


def as_is(df: DataFrame, name: str) -> DataFrame:
    return df


def stage_in(spark: SparkSession, label: str) -> Stage:
    """Stages that outlive the caller, for results that are still lazy."""
    return _stage_under(spark, session.work_dir(spark, label))


@contextmanager
def staging(spark: SparkSession, label: str) -> Iterator[Stage]:
    """Stages of one job, removed when it has written its result."""
    scratch = session.work_dir(spark, label)
    try:
        yield _stage_under(spark, scratch)
    finally:
        session.remove(spark, [scratch])


def _stage_under(spark: SparkSession, scratch: str) -> Stage:
    taken: dict[str, int] = {}

    def stage(df: DataFrame, name: str) -> DataFrame:
        taken[name] = taken.get(name, 0) + 1
        path = f"{scratch}/{name}-{taken[name]}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return stage
