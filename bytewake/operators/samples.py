"""From raw transfer samples to byte counters per process and minute."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from bytewake.config import EGRESS, INGRESS, PROCESS, UNKNOWN_TGID, UNRESOLVED
from bytewake.functions import calendar
from bytewake.functions.network import direction_of_hook, scope_of


def positive_bytes(samples: DataFrame) -> DataFrame:
    """Transfers that moved data.  Errors are negative, empty transfers zero."""
    return samples.where(F.col("ret") > 0)


def transfers(samples: DataFrame, *keep: str) -> DataFrame:
    """Counted transfers with direction and scope; addresses end here.

    ``keep`` names further sample columns to carry.  Samples of an unknown
    observation point have no direction and are not counted.  Bytes without a
    host or process number are kept, under a host and number that nobody has.
    """
    counted = positive_bytes(samples)
    return counted.select(
        F.coalesce("host", F.lit(UNRESOLVED)).alias("host"),
        F.coalesce("tgid", F.lit(UNKNOWN_TGID)).cast("long").alias("tgid"),
        "ts",
        direction_of_hook(F.col("hook")).alias("dir"),
        scope_of(F.col("family"), F.col("daddr"), F.col("saddr")).alias("scope"),
        F.col("ret").alias("bytes"),
        *keep,
    ).where(F.col("dir").isNotNull())


def direction_sums(direction: Column, volume: Column) -> list[Column]:
    """The ingress and egress byte columns; other directions add nothing."""
    return [
        F.sum(F.when(direction == side, volume).otherwise(F.lit(0))).alias(f"{side}_bytes")
        for side in (INGRESS, EGRESS)
    ]


def counter_fold(moved: DataFrame) -> DataFrame:
    """Total bytes per process, direction and scope."""
    return moved.groupBy(*PROCESS, "dir", "scope").agg(F.sum("bytes").alias("bytes"))


def direction_pivot(moved: DataFrame, *keys: str | Column) -> DataFrame:
    """Fold the direction into a column pair, in one pass."""
    return moved.groupBy(*keys).agg(*direction_sums(F.col("dir"), F.col("bytes")))


def closed_minute_fold(samples: DataFrame, now: datetime) -> DataFrame:
    """``minute_fold`` of the minutes strictly before the open one; the bound reaches the scan."""
    return minute_fold(samples.where(F.col("ts") < calendar.at(calendar.floor_moment(now, "minute", "UTC"))))


def minute_fold(samples: DataFrame) -> DataFrame:
    """One row per process, minute and scope, with the span of its samples.

    Everything later works on these rows.  All aggregates have fixed width, so
    the sums form in hash maps before the shuffle and a process that sends a
    third of all samples arrives as at most two rows per minute and task.
    """
    return (
        transfers(samples)
        .groupBy(*PROCESS, calendar.minute_start(F.col("ts")).alias("bucket"), "scope")
        .agg(
            *direction_sums(F.col("dir"), F.col("bytes")),
            F.min("ts").alias("min_ts"),
            F.max("ts").alias("max_ts"),
        )
    )


def split_fold(samples: DataFrame, contested: DataFrame) -> DataFrame:
    """``minute_fold``, but by ``instant`` in the contested (process, minute) keys, in the same scan.

    ``instant`` is null elsewhere.  Contested keys are few, so which way they
    are joined is left to their measured size.
    """
    moved = transfers(samples).withColumn("bucket", calendar.minute_start(F.col("ts")))
    return _by_instant(moved, contested, "ts").agg(
        *direction_sums(F.col("dir"), F.col("bytes")), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))


def split_parts(parts: DataFrame, contested: DataFrame) -> DataFrame:
    """``split_fold`` of minutes that come in parts: those of contested minutes stay apart, at their first sample."""
    return _by_instant(parts, contested, "min_ts").agg(
        *[F.sum(c).alias(c) for c in ("ingress_bytes", "egress_bytes")],
        F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts"))


def _by_instant(rows: DataFrame, contested: DataFrame, ts: str) -> GroupedData:
    marked = rows.join(contested.withColumn("contested", F.lit(True)), [*PROCESS, "bucket"], "left")
    return marked.groupBy(*PROCESS, "bucket", "scope", F.when(F.col("contested"), F.col(ts)).alias("instant"))


def first_sight(observations: DataFrame, payload: list[str], order: list[str]) -> DataFrame:
    """Per process the first observation; later ones are ignored."""
    first = F.min_by(F.struct(*payload), F.struct(*order)).alias("first")
    return observations.groupBy(*PROCESS).agg(first).select(*PROCESS, "first.*")


def closed_minutes(folded: DataFrame, now: datetime) -> DataFrame:
    """Rows of minutes strictly before the open one."""
    return folded.where(F.col("bucket") < calendar.at(calendar.floor_moment(now, "minute", "UTC")))
