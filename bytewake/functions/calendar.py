"""Bucket starts.  Minutes and hours are UTC, days and months follow a zone.

Local calendars go through ``from_utc_timestamp``, which shifts the instant
itself, so the session zone must be UTC (``session.tune``).
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MICROSECOND = timedelta(microseconds=1)
MINUTE = timedelta(minutes=1)
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00", "Universal", "Etc/Universal", "Zulu", "Etc/Zulu")


def require_utc(spark: SparkSession) -> None:
    """Refuse a session in whose zone local calendars would come out wrong."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"the session's zone is {zone}; set spark.sql.session.timeZone to UTC")


def _floor_seconds(ts: Column, width: int) -> Column:
    seconds = F.unix_seconds(ts)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(width)))


def minute_start(ts: Column) -> Column:
    return _floor_seconds(ts, 60)


def hour_start(ts: Column) -> Column:
    return _floor_seconds(ts, 3600)


def local_start(ts: Column, unit: str, tz: str) -> Column:
    """UTC instant at which the local day or month of ``ts`` began."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        require_utc(spark)
    return F.to_utc_timestamp(F.date_trunc(unit, F.from_utc_timestamp(ts, tz)), tz)


def tier_start(ts: Column, tier: str, tz: str) -> Column:
    if tier == "minute":
        return minute_start(ts)
    if tier == "hour":
        return hour_start(ts)
    if tier in ("day", "month"):
        return local_start(ts, tier, tz)
    raise ValueError(f"unknown tier {tier!r}")


def utc_date(ts: Column) -> Column:
    """Partition date of a bucket; independent of the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(ts) / F.lit(86400)).cast("int"))


def at(moment: datetime) -> Column:
    """A literal instant."""
    return F.timestamp_micros(F.lit(micros(moment)))


def micros(moment: datetime) -> int:
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    return (aware - EPOCH) // timedelta(microseconds=1)


def floor_moment(moment: datetime, tier: str, tz: str) -> datetime:
    """``tier_start`` for one plain instant, used to build scan bounds."""
    utc = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    if tier == "minute":
        return utc.astimezone(timezone.utc).replace(second=0, microsecond=0)
    if tier == "hour":
        return utc.astimezone(timezone.utc).replace(minute=0, second=0, microsecond=0)
    local = utc.astimezone(ZoneInfo(tz)).replace(hour=0, minute=0, second=0, microsecond=0, fold=0)
    if tier == "month":
        local = local.replace(day=1)
    return local.astimezone(timezone.utc)
