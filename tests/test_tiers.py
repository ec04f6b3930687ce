from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bytewake import schemas
from bytewake.config import Settings
from bytewake.functions import calendar
from bytewake.operators import tiers
from bytewake.plans.reconcile import late_samples
from tests.conftest import rows_of, utc

NEW_YORK = "America/New_York"
KOLKATA = "Asia/Kolkata"


def facts(spark, *rows):
    return spark.createDataFrame([(b, i, s, x, y) for b, i, s, x, y in rows], schemas.TRAFFIC)


def stamped(df):
    """Rows with the bucket as UTC text."""
    return rows_of(df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm")))


NOON = utc(2026, 7, 6, 12)


def test_merge_adds_up(spark):
    delta = facts(spark, (NOON, 1, "external", 100, 50))
    assert stamped(tiers.minute_merge(delta, delta)) == [("2026-07-06 12:00", 1, "external", 200, 100)]
    more = facts(spark, (NOON, 1, "external", 20, 5), (NOON, 1, "loopback", 1, 1))
    assert stamped(tiers.minute_merge(delta, more)) == [
        ("2026-07-06 12:00", 1, "external", 120, 55), ("2026-07-06 12:00", 1, "loopback", 1, 1),
    ]


def test_more_rows_are_merged_by_more_tasks(spark):
    smaller = {f"spark.sql.adaptive.{key}": "64k" for key in ("advisoryPartitionSizeInBytes", "coalescePartitions.minPartitionSize")}
    before = {key: spark.conf.get(key) for key in smaller}
    for key, size in smaller.items():
        spark.conf.set(key, size)
    try:
        rows = spark.range(400_000, numPartitions=4).select(
            F.timestamp_seconds(F.col("id") * 60).alias("bucket"), F.xxhash64("id").alias("identity_id"),
            F.lit("external").alias("scope"), F.col("id").alias("ingress_bytes"), F.col("id").alias("egress_bytes"))
        merged = tiers.minute_merge(rows).withColumn("task", F.spark_partition_id())
        assert merged.select("task").distinct().count() > 20
    finally:
        for key, size in before.items():
            spark.conf.set(key, size)


def test_bytes_overflow_raises(spark):
    huge = facts(spark, (NOON, 1, "external", 2**63 - 1, 0), (NOON, 1, "external", 1, 0))
    with pytest.raises(Exception, match="OVERFLOW"):
        tiers.minute_merge(huge).collect()


def test_hours_are_utc_and_open_minute_stays(spark):
    df = facts(spark, *[(NOON + timedelta(minutes=m), 1, "external", 1, 2) for m in (0, 59, 60, 61)])
    hours = tiers.rollup(df, "hour", NOON + timedelta(minutes=61, seconds=30), NEW_YORK)
    assert stamped(hours) == [("2026-07-06 12:00", 1, "external", 2, 4), ("2026-07-06 13:00", 1, "external", 1, 2)]


@pytest.mark.parametrize("start, hours", [(utc(2024, 3, 10, 5), 23), (utc(2024, 11, 3, 4), 25), (utc(2024, 6, 1, 4), 24)])
def test_local_days_have_23_to_25_hours(spark, start, hours):
    df = facts(spark, *[(start + timedelta(hours=h), 1, "external", 1, 0) for h in range(-1, hours + 1)])
    days = tiers.rollup(df, "day", start + timedelta(days=3), NEW_YORK)
    middle = days.where(F.col("bucket") == calendar.at(start))
    assert rows_of(middle, "ingress_bytes") == [(hours,)]
    assert days.count() == 3


def test_months_begin_locally(spark):
    df = facts(spark, (utc(2024, 1, 1, 5), 1, "external", 1, 0), (utc(2023, 12, 31, 5), 1, "external", 2, 0))
    months = tiers.rollup(df, "month", utc(2024, 3, 1), NEW_YORK)
    assert stamped(months) == [("2023-12-01 05:00", 1, "external", 2, 0), ("2024-01-01 05:00", 1, "external", 1, 0)]


def test_hour_decides_the_day_unless_exact(spark):
    # local midnight in Kolkata is 18:30 UTC
    df = facts(spark, (utc(2024, 1, 1, 18, 10), 1, "external", 1, 0), (utc(2024, 1, 1, 18, 40), 1, "external", 2, 0))
    now = utc(2024, 1, 5)
    via_hours = tiers.rollup(tiers.rollup(df, "hour", now, KOLKATA), "day", now, KOLKATA)
    assert stamped(via_hours) == [("2023-12-31 18:30", 1, "external", 3, 0)]
    assert stamped(tiers.rollup(df, "day", now, KOLKATA, source="minute")) == [
        ("2023-12-31 18:30", 1, "external", 1, 0), ("2024-01-01 18:30", 1, "external", 2, 0),
    ]


def test_rollup_in_parts_equals_rollup_at_once(spark):
    df = facts(spark, *[(NOON + timedelta(minutes=7 * m), m % 3, "external", m, 1) for m in range(60)])
    end = NOON + timedelta(days=1)
    cut = NOON + timedelta(minutes=95, seconds=10)
    first = tiers.rollup(df, "hour", cut, "UTC")
    second = tiers.rollup(df, "hour", end, "UTC", watermark=tiers.closed_bound("hour", cut, "UTC"))
    assert stamped(tiers.minute_merge(first, second)) == stamped(tiers.rollup(df, "hour", end, "UTC"))


def test_prune_waits_for_the_rollup(spark):
    settings = Settings()
    old, now = utc(2024, 1, 1), utc(2024, 1, 10)
    df = facts(spark, (old, 1, "external", 1, 1), (utc(2024, 1, 9), 1, "external", 2, 2))
    assert tiers.prune_retention(df, "minute", now, settings, None).count() == 2
    assert tiers.prune_retention(df, "minute", now, settings, old).count() == 2
    kept = tiers.prune_retention(df, "minute", now, settings, utc(2024, 1, 10))
    assert stamped(kept) == [("2024-01-09 00:00", 1, "external", 2, 2)]
    assert tiers.prune_retention(df, "month", now, settings, None).count() == 2


def test_constraints_name_what_is_wrong(spark):
    identity = spark.createDataFrame(
        [(1, "h", 1000, "u", "/bin/x", "<none>", "x", None, None, None, NOON, NOON),
         (2, "h", 1000, "u", "/bin/x", "<none>", "x", None, None, None, NOON, NOON)], schemas.IDENTITY)
    df = facts(spark, (NOON, 1, "lan", 0, 0), (NOON, 1, "external", 0, 0), (NOON, 1, "external", 0, 0),
               (NOON, 9, "external", 0, 0), (NOON, None, "external", 0, 0))
    assert dict(rows_of(tiers.tier_violations(df, identity))) == {
        "scope_domain": 1, "not_null": 1, "tier_key": 1, "identity_reference": 1, "natural_key": 1,
    }
    fine = facts(spark, (NOON, 1, "external", 0, 0))
    assert {v for _, v in rows_of(tiers.tier_violations(fine, identity.where("id = 1")))} == {0}


def test_only_coarse_tiers_have_watermarks(spark):
    log = spark.createDataFrame([("hour",), ("day",), ("month",), ("minute",), ("week",)], "tier string")
    assert rows_of(tiers.watermark_violations(log)) == [("watermark_tier", 2)]


def test_late_correction_may_be_negative(spark):
    want = facts(spark, (NOON, 1, "external", 5, 0), (NOON, 2, "external", 3, 0), (NOON, 4, "external", 1, 1))
    have = facts(spark, (NOON, 1, "external", 7, 0), (NOON, 3, "external", 1, 0), (NOON, 4, "external", 1, 1))
    assert [r[1:] for r in stamped(late_samples(want, have))] == [
        (1, "external", -2, 0), (2, "external", 3, 0), (3, "external", -1, 0),
    ]


def test_plain_and_column_bounds_agree(spark):
    zones = (NEW_YORK, KOLKATA, "America/Sao_Paulo", "UTC", "Europe/Berlin")
    moments = [utc(2018, 11, 4, 2, 30) + timedelta(hours=7 * h) for h in range(300)] + [
        utc(2024, 3, 10, 3) + timedelta(hours=h) for h in range(60)
    ]
    df = spark.createDataFrame([(m,) for m in moments], "ts timestamp")
    for tz in zones:
        for tier in ("minute", "hour", "day", "month"):
            got = df.select(
                F.unix_micros("ts").alias("t"), F.unix_micros(calendar.tier_start(F.col("ts"), tier, tz)).alias("b")
            ).collect()
            for row, moment in zip(got, moments):
                assert row.b == calendar.micros(calendar.floor_moment(moment, tier, tz)), (tz, tier, moment)
