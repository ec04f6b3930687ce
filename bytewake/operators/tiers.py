"""Tier facts: additive merge, rollup, retention and integrity checks."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytewake.config import COARSER, FINER, NATURAL_KEY, SCOPES, TIER_KEY, Settings
from bytewake.functions import calendar


# folders of the coarse tiers hold more than a date
FOLDER_UNIT = {"day": "month", "month": "year"}


def byte_sums() -> list[Column]:
    return [F.sum("ingress_bytes").alias("ingress_bytes"), F.sum("egress_bytes").alias("egress_bytes")]


def minute_merge(*deltas: DataFrame) -> DataFrame:
    """Add up deltas: rows of one (bucket, identity, scope) become one."""
    rows = deltas[0].select(*TIER_KEY, "ingress_bytes", "egress_bytes")
    for delta in deltas[1:]:
        rows = rows.unionByName(delta.select(*rows.columns))
    return rows.groupBy(*TIER_KEY).agg(*byte_sums())


def checked(facts: DataFrame) -> DataFrame:
    """Facts as they are; a row that breaks a constraint of its own fails the query that reads it."""
    complete = F.lit(True)
    for column in (*TIER_KEY, "ingress_bytes", "egress_bytes"):
        complete &= F.col(column).isNotNull()
    valid = complete & F.col("scope").isin(*SCOPES)
    told = F.concat(F.lit("not a tier row: "), F.to_json(F.struct(*TIER_KEY)))
    return facts.withColumn("scope", F.when(valid, F.col("scope")).otherwise(F.raise_error(told).cast("string")))


def folder_of(day: Column, tier: str) -> Column:
    """The date that names the folder of a bucket: about as many buckets lie in each of every tier."""
    unit = FOLDER_UNIT.get(tier)
    return F.trunc(day, unit).cast("date") if unit else day


def folder_date(day: date, tier: str) -> date:
    """``folder_of`` for a plain date."""
    unit = FOLDER_UNIT.get(tier)
    return day.replace(day=1, **({"month": 1} if unit == "year" else {})) if unit else day


def roll(facts: DataFrame, tier: str, tz: str) -> DataFrame:
    """Aggregate finer facts to ``tier``.  Partial sums form before the shuffle."""
    bucket = calendar.tier_start(F.col("bucket"), tier, tz).alias("bucket")
    return facts.groupBy(bucket, "identity_id", "scope").agg(*byte_sums())


def source_of(tier: str, settings: Settings) -> str:
    """Tier that ``tier`` is rolled up from.

    Days come from hours, so in a zone whose offset is no whole hour the hour
    around local midnight goes where its start lies.  ``exact_days`` takes the
    minutes instead.
    """
    return "minute" if tier == "day" and settings.exact_days else FINER[tier]


def closed_bound(tier: str, now: datetime, tz: str, source: str | None = None) -> datetime:
    """Start of the open bucket of the source tier; everything before is closed."""
    return calendar.floor_moment(now, source or FINER[tier], tz)


def rollup(
    facts: DataFrame, tier: str, now: datetime, tz: str,
    watermark: datetime | None = None, source: str | None = None,
) -> DataFrame:
    """Delta for ``tier``: closed finer buckets at or past the watermark.

    The watermark counts finer buckets, so a coarse bucket may arrive in
    several deltas that add up.
    """
    bucket = F.col("bucket")
    due = facts.where(bucket < calendar.at(closed_bound(tier, now, tz, source)))
    if watermark is not None:
        due = due.where(bucket >= calendar.at(watermark))
    return roll(due, tier, tz)


def prune_bound(
    tier: str, now: datetime, settings: Settings, rolled_through: datetime | None
) -> datetime | None:
    """Rows before this instant may go: past retention and already rolled up."""
    keep = settings.retention[tier]
    if keep is None:
        return None
    if tier in COARSER and rolled_through is None:
        return None
    bound = now - keep
    return bound if tier not in COARSER else min(bound, rolled_through)


def prune_retention(
    facts: DataFrame, tier: str, now: datetime, settings: Settings, rolled_through: datetime | None
) -> DataFrame:
    """Rows that stay."""
    bound = prune_bound(tier, now, settings, rolled_through)
    return facts if bound is None else facts.where(F.col("bucket") >= calendar.at(bound))


def tier_violations(facts: DataFrame, identity: DataFrame) -> DataFrame:
    """What the declared constraints of a tier table would reject, counted.

    One aggregation by key answers scope, NULL and key checks together; only
    the distinct identity ids meet the dimension.
    """
    required = [F.col(c).isNull() for c in (*TIER_KEY, "ingress_bytes", "egress_bytes")]
    missing = required[0]
    for check in required[1:]:
        missing = missing | check
    per_key = facts.groupBy(*TIER_KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(missing.cast("long")).alias("missing")
    )
    # a NULL scope is a NULL violation, not a domain violation
    stray = F.when(~F.col("scope").isin(*SCOPES), F.col("n"))
    complete = F.col("bucket").isNotNull() & F.col("identity_id").isNotNull() & F.col("scope").isNotNull()
    row_checks = per_key.agg(
        F.coalesce(F.sum(stray), F.lit(0)).alias("scope_domain"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("not_null"),
        F.count(F.when(complete & (F.col("n") > 1), True)).alias("tier_key"),
    )
    ids = facts.groupBy("identity_id").agg(F.count(F.lit(1)).alias("n"))
    orphans = (
        ids.where(F.col("identity_id").isNotNull())
        .join(identity.select(F.col("id").alias("identity_id")), "identity_id", "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
        .select(F.lit("identity_reference").alias("rule"), "violations")
    )
    twins = (
        identity.groupBy(*NATURAL_KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .agg(F.count(F.lit(1)).alias("violations"))
        .select(F.lit("natural_key").alias("rule"), "violations")
    )
    return row_checks.unpivot([], ["scope_domain", "not_null", "tier_key"], "rule", "violations").unionByName(
        orphans
    ).unionByName(twins)


def watermark_violations(log: DataFrame) -> DataFrame:
    """Watermark entries for a tier that has none, counted."""
    stray = log.where(~F.col("tier").isin(*FINER))
    return stray.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit("watermark_tier").alias("rule"), "violations"
    )
