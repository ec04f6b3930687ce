"""The query verbs: top, series, list, show, and what they share.

Visibility is decided in one place, ``visible``; verbs reach facts only through
the identities it lets pass.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytewake.config import (
    ALL_SCOPES, BOTH, DEFAULT_LIMIT, EGRESS, EXTERNAL, INGRESS, TIERS, UNRESOLVED, Settings,
)
from bytewake.functions import calendar
from bytewake.operators.tiers import byte_sums, minute_merge, source_of

GROUP_COLUMNS = {"identity": "id", "project": "project_root", "exe": "exe", "user": "uid"}
MINUTE_SPAN = timedelta(hours=6)
HOUR_SPAN = timedelta(hours=48)
DAY_SPAN = timedelta(days=31)


# -- windows and predicates -------------------------------------------------

def time_window(
    now: datetime,
    tz: str,
    since: timedelta | None = None,
    preset: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> tuple[datetime, datetime]:
    """Half-open window [from, to) in UTC; today and this-month begin locally."""
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    if preset == "today":
        return calendar.floor_moment(now, "day", tz), now
    if preset == "this-month":
        return calendar.floor_moment(now, "month", tz), now
    if preset is not None:
        raise ValueError(f"unknown preset {preset!r}")
    if since is not None:
        return now - since, now
    if start is None:
        raise ValueError("give since, preset or start")
    return start, end if end is not None else now


def pick_tier(
    window: tuple[datetime, datetime],
    now: datetime,
    settings: Settings,
    preset: str | None = None,
    tier: str | None = None,
) -> str:
    """Tier that answers a window; an explicit one wins."""
    if tier is not None:
        if tier not in TIERS:
            raise ValueError(f"unknown tier {tier!r}")
        return tier
    if preset == "this-month":
        return "month"
    start, end = window
    span = end - start
    spans = (("minute", MINUTE_SPAN), ("hour", HOUR_SPAN), ("day", DAY_SPAN))
    for name, limit in spans:
        keep = settings.retention[name]
        held = keep is None or start >= now - keep
        if span <= limit and held:
            return name
    return "month"


# (tier, start, end): buckets of one tier that begin in [start, end)
Piece = tuple[str, datetime, datetime]


def next_start(moment: datetime, tier: str, tz: str) -> datetime:
    """First bucket start at or after a moment."""
    floor = calendar.floor_moment(moment, tier, tz)
    if floor >= moment:
        return floor
    # the longest bucket of each tier, and a little more: that lands in the next one
    span = {"minute": timedelta(minutes=1), "hour": timedelta(hours=1), "day": timedelta(hours=26), "month": timedelta(days=32)}
    return calendar.floor_moment(floor + span[tier], tier, tz)


def window_pieces(
    window: tuple[datetime, datetime], tier: str, settings: Settings,
    rolled: dict[str, datetime | None], pruned: dict[str, datetime | None],
) -> list[Piece]:
    """Pieces that together hold every byte of a window, each byte once.

    Whole buckets come from ``tier``, as far as it has been rolled up; what lies
    before the first of them, after the last, or past that bound comes from the
    next finer tier, and so on to minutes.  Where the finer tier's rows are gone
    the piece is widened to the coarse bucket instead, so the first and last
    piece tell the window that is really answered.
    """
    start, end = (m if m.tzinfo else m.replace(tzinfo=timezone.utc) for m in window)
    if start >= end:
        return []
    start = calendar.floor_moment(start, "minute", settings.tz)
    if tier == "minute":
        return [("minute", start, end)]
    finer = source_of(tier, settings)
    gone = pruned.get(finer)
    through = rolled.get(tier)
    if through is None:
        return window_pieces((start, end), finer, settings, rolled, pruned)
    first = next_start(start, tier, settings.tz)
    if first != start and gone is not None and gone > start:
        first = calendar.floor_moment(start, tier, settings.tz)
    last = calendar.floor_moment(min(end, through), tier, settings.tz)
    if gone is not None and last < min(end, through) and gone > last:
        # rows of the bucket that the end falls into are gone: all of it that was rolled up
        last = min(next_start(min(end, through), tier, settings.tz), through)
    if first >= last:
        return window_pieces((start, end), finer, settings, rolled, pruned)
    return [
        *window_pieces((start, first), finer, settings, rolled, pruned), (tier, first, last),
        *window_pieces((last, end), finer, settings, rolled, pruned),
    ]


def in_window(facts: DataFrame, window: tuple[datetime, datetime]) -> DataFrame:
    start, end = window
    bucket = F.col("bucket")
    return facts.where((bucket >= calendar.at(start)) & (bucket < calendar.at(end)))


def in_scope(facts: DataFrame, scope: str | None = None) -> DataFrame:
    """External unless asked otherwise; ``all`` adds no predicate."""
    wanted = scope or EXTERNAL
    return facts if wanted == ALL_SCOPES else facts.where(F.col("scope") == wanted)


def direction_columns(direction: str = BOTH) -> list[str]:
    """The byte columns of a view; there is never a total."""
    columns = {INGRESS: ["ingress_bytes"], EGRESS: ["egress_bytes"], BOTH: ["ingress_bytes", "egress_bytes"]}
    return columns[direction]


def sees_all(caller_uid: int, settings: Settings = Settings(), is_admin: bool = False) -> bool:
    """Root always does, and so do admins."""
    return caller_uid == 0 or caller_uid in settings.admin_uids or is_admin


def visible(
    identity: DataFrame, caller_uid: int, settings: Settings = Settings(),
    is_admin: bool = False, uid: int | None = None, caller_host: str | None = None,
) -> DataFrame:
    """Identities the caller may see.

    A caller is a user of one host: the same number on another host is someone
    else.  Only root and admins see the fleet, and may choose a uid.
    """
    if sees_all(caller_uid, settings, is_admin):
        return identity if uid is None else identity.where(F.col("uid") == uid)
    if caller_host is None:
        raise ValueError("a caller that is no admin belongs to a host")
    return identity.where((F.col("uid") == caller_uid) & (F.col("host") == caller_host))


def dimension_filter(
    identity: DataFrame, project: str | None = None, exe: str | None = None, user: str | None = None
) -> DataFrame:
    for column, value in (("project_root", project), ("exe", exe), ("username", user)):
        if value is not None:
            identity = identity.where(F.col(column) == value)
    return identity


# -- verbs ------------------------------------------------------------------

def _volume(direction: str) -> Column:
    columns = [F.col(c) for c in direction_columns(direction)]
    return columns[0] if len(columns) == 1 else columns[0] + columns[1]


def of_identities(facts: DataFrame, identity: DataFrame) -> DataFrame:
    """Facts of the identities given; only ids travel."""
    return facts.join(identity.select(F.col("id").alias("identity_id")), "identity_id", "left_semi")


def of_few(facts: DataFrame, identity: DataFrame, most: int) -> DataFrame:
    """Facts of the identities given, by their ids where there are at most ``most``; then scans skip what holds none of them."""
    found = [r[0] for r in identity.select("id").limit(most + 1).collect()]
    return facts.where(F.col("identity_id").isin(found)) if len(found) <= most else facts


def _labelled(identity: DataFrame, by: str) -> DataFrame:
    key = F.col(GROUP_COLUMNS[by])
    label = {"identity": F.col("exe"), "user": F.col("username")}.get(by, key)
    return identity.select(
        F.col("id").alias("identity_id"), "host", key.alias("group_key"), label.alias("label")
    )


def grouped(facts: DataFrame, identity: DataFrame, by: str, narrowed: bool = False) -> DataFrame:
    """Bytes per group of identities.

    Facts shrink to one row per identity before they meet the dimension, so
    the join never sees a busy identity more than once.  ``narrowed`` says that
    few identities are left: then facts of the others are dropped first.
    """
    if narrowed:
        facts = of_identities(facts, identity)
    totals = facts.groupBy("identity_id").agg(*byte_sums())
    joined = totals.join(_labelled(identity, by), "identity_id")
    if by == "identity":
        return joined.select("host", "group_key", "label", "ingress_bytes", "egress_bytes")
    return joined.groupBy("host", "group_key").agg(F.max("label").alias("label"), *byte_sums())


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit or DEFAULT_LIMIT)


def top(
    facts: DataFrame,
    identity: DataFrame,
    by: str = "identity",
    limit: int | None = 0,
    scope: str | None = None,
    direction: str = BOTH,
    narrowed: bool = False,
) -> DataFrame:
    """Biggest talkers of the facts given, as ranked rows.

    A limit of 0 is the default one, None is no limit.

    Both directions together decide the rank but are not shown as one number.
    Hosts are apart, because user numbers and paths mean nothing across hosts.
    Single identities are ranked by id before their wide rows are looked up.
    """
    facts = in_scope(facts, scope)
    if by == "identity":
        if narrowed:
            facts = of_identities(facts, identity)
        totals = of_identities(facts.groupBy("identity_id").agg(*byte_sums()), identity)
        first = limited(totals.orderBy(_volume(direction).desc(), "identity_id"), limit)
        ranked = first.join(_labelled(identity, by), "identity_id").orderBy(_volume(direction).desc(), "group_key")
    else:
        groups = grouped(facts, identity, by, narrowed)
        ranked = limited(groups.orderBy(_volume(direction).desc(), "host", "group_key"), limit)
    return ranked.select(
        "host", F.col("group_key").cast("string").alias("group_key"), "label", *direction_columns(direction)
    )


def top_per_bucket(
    facts: DataFrame, identity: DataFrame, by: str = "identity", limit: int | None = 0,
    scope: str | None = None,
) -> DataFrame:
    """The ranking of ``top`` inside every bucket.

    A rank bounded by ``limit`` lets each task discard losers before the rows
    of a bucket come together.
    """
    key = F.col(GROUP_COLUMNS[by])
    totals = minute_merge(in_scope(facts, scope)).groupBy("bucket", "identity_id").agg(*byte_sums())
    labelled = identity.select(F.col("id").alias("identity_id"), "host", key.alias("group_key"))
    groups = totals.join(labelled, "identity_id").groupBy("bucket", "host", "group_key").agg(*byte_sums())
    order = Window.partitionBy("bucket").orderBy(_volume(BOTH).desc(), "host", "group_key")
    ranked = groups.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= (limit or DEFAULT_LIMIT))
    return ranked.withColumn("group_key", F.col("group_key").cast("string"))


def series(
    facts: DataFrame, identity: DataFrame, identity_id: int,
    window: tuple[datetime, datetime], scope: str | None = None,
) -> DataFrame:
    """History of one identity, ordered by bucket and scope."""
    one = identity.where(F.col("id") == identity_id).select(F.col("id").alias("identity_id"))
    rows = in_scope(in_window(facts, window), scope).where(F.col("identity_id") == identity_id)
    return minute_merge(rows.join(one, "identity_id", "left_semi")).orderBy("bucket", "scope")


def list_identities(identity: DataFrame, text: str = "") -> DataFrame:
    """Identities whose exe, project root or comm contains ``text`` literally."""
    if not text:
        return identity
    needle = F.lit(text)
    found = F.contains("exe", needle) | F.contains("project_root", needle)
    return identity.where(found | F.coalesce(F.contains("comm", needle), F.lit(False)))


def show_identity(identity: DataFrame, identity_id: int) -> DataFrame:
    """Full detail, zero or one row."""
    return identity.where(F.col("id") == identity_id)


def require_identity(identity: DataFrame, identity_id: int):
    """The row of ``show_identity``; unknown ids raise LookupError."""
    rows = show_identity(identity, identity_id).take(1)
    if not rows:
        raise LookupError(f"no identity {identity_id}")
    return rows[0]


# -- results ----------------------------------------------------------------

def counter_rows(facts: DataFrame) -> DataFrame:
    """Facts as they travel: bucket starts as milliseconds."""
    return facts.select(
        "identity_id", F.unix_millis("bucket").alias("bucket_unix_ms"), "scope", "ingress_bytes", "egress_bytes"
    )


def referenced_identities(counters: DataFrame, identity: DataFrame) -> DataFrame:
    """Dimension rows that occur in a result."""
    ids = counters.select(F.col("identity_id").alias("id")).distinct()
    return identity.join(ids, "id", "left_semi")


def unresolved_share(facts: DataFrame, identity: DataFrame, by: str = "user", scope: str | None = None) -> DataFrame:
    """Bytes per group that could be attributed in full, and only coarsely."""
    totals = in_scope(facts, scope).groupBy("identity_id").agg(*byte_sums())
    coarse = F.col("exe") == UNRESOLVED
    labelled = identity.select(
        F.col("id").alias("identity_id"), "host",
        F.col(GROUP_COLUMNS[by]).cast("string").alias("group_key"), coarse.alias("coarse"),
    )
    sums = [
        F.sum(F.when(F.col("coarse") == flag, F.col(f"{side}_bytes")).otherwise(0)).alias(f"{name}_{side}_bytes")
        for name, flag in (("resolved", False), ("unresolved", True))
        for side in (INGRESS, EGRESS)
    ]
    return totals.join(labelled, "identity_id").groupBy("host", "group_key").agg(*sums)
