"""The query verbs over wide traffic."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytewake.config import FINER, Settings
from bytewake.operators import tiers, verbs
from bytewake.plans.reader import Asked, Reader
from bytewake.session import work_dir
from bytewake.sources.store import IDENTITY_TABLE, Store
from checks import fixtures as fx
from checks.fixtures import SUMS, TZ, ms, oracle
from checks.registry import as_ms, check, fact_rows

SETTINGS = Settings(tz=TZ)
YEAR = (datetime(2001, 1, 1, tzinfo=timezone.utc), fx.WIDE_NOW)
IN_YEAR = "bucket >= TIMESTAMP '2001-01-01 00:00:00' AND bucket < TIMESTAMP '2001-11-05 00:00:00'"
FACT = f"{ms('bucket', 'bucket_ms')}, identity_id, scope, ingress_bytes, egress_bytes"


def facts(spark, sf, window=YEAR):
    return verbs.in_window(everything(spark, sf), window)


def everything(spark, sf):
    return fx.view(spark, sf, "traffic_wide")


def identities(spark, sf):
    return fx.view(spark, sf, "identity_wide")


def top_sql(key: str, label: str, where: str = "", limit: int = 20, columns: str = "ingress_bytes, egress_bytes",
            order: str = "ingress_bytes + egress_bytes", scope: str = "scope = 'external'", ties: str = "host, g.group_key") -> str:
    return oracle(f"""SELECT host, CAST(group_key AS VARCHAR) AS group_key, label, {columns} FROM (
  SELECT i.host, {key} AS group_key, max({label}) AS label, {SUMS}
  FROM traffic_wide f JOIN identity_wide i ON i.id = f.identity_id
  WHERE {scope} AND {IN_YEAR} {where} GROUP BY i.host, {key}) g
  ORDER BY {order} DESC, {ties} LIMIT {limit}""", "traffic_wide", "identity_wide")


@check(top_sql("i.id", "i.exe", ties="g.group_key"))
def top_by_identity(spark, sf):
    return verbs.top(facts(spark, sf), identities(spark, sf), "identity")


@check(top_sql("i.project_root", "i.project_root", limit=15))
def top_by_project(spark, sf):
    return verbs.top(facts(spark, sf), identities(spark, sf), "project", limit=15)


@check(top_sql("i.exe", "i.exe", limit=10))
def top_by_exe(spark, sf):
    return verbs.top(facts(spark, sf), identities(spark, sf), "exe", limit=10)


@check(top_sql("i.uid", "i.username", scope="TRUE", limit=30))
def top_by_user(spark, sf):
    return verbs.top(facts(spark, sf), identities(spark, sf), "user", limit=30, scope="all")


@check(top_sql("i.id", "i.exe", columns="egress_bytes", order="egress_bytes", limit=25, ties="g.group_key"))
def direction_columns(spark, sf):
    return verbs.top(facts(spark, sf), identities(spark, sf), "identity", limit=25, direction="egress")


def narrowed_sql(name: str, key: str, where: str) -> str:
    return f"""SELECT '{name}' AS asked, i.host, {key} AS group_key, {SUMS}
  FROM traffic_wide f JOIN identity_wide i ON i.id = f.identity_id
  WHERE scope = 'external' AND {where} GROUP BY i.host, {key}"""


@check(oracle(" UNION ALL ".join([
    narrowed_sql("exe", "i.project_root", "i.exe = '/usr/bin/app4'"),
    narrowed_sql("user", "i.exe", "i.username = 'NATION_3'"),
    narrowed_sql("project", "i.exe", "i.project_root = '<none>' AND i.exe = '/usr/bin/app10'")]),
    "traffic_wide", "identity_wide"))
def dimension_filters(spark, sf):
    rows, identity = verbs.in_scope(everything(spark, sf)), identities(spark, sf)
    asked = {
        "exe": ("project", dict(exe="/usr/bin/app4")),
        "user": ("exe", dict(user="NATION_3")),
        "project": ("exe", dict(project="<none>", exe="/usr/bin/app10")),
    }
    result = None
    for name, (by, narrow) in asked.items():
        groups = verbs.grouped(rows, verbs.dimension_filter(identity, **narrow), by, narrowed=True)
        part = groups.select(F.lit(name).alias("asked"), "host", "group_key", "ingress_bytes", "egress_bytes")
        result = part if result is None else result.unionByName(part)
    return result


@check(oracle(f"""SELECT {FACT} FROM (
  SELECT * FROM days WHERE identity_id = 11 AND bucket >= TIMESTAMP '2000-01-01 05:00:00' AND bucket < TIMESTAMP '2001-01-01 05:00:00'
  ) s ORDER BY bucket, scope""", "days"))
def series(spark, sf):
    """One identity by local day over a local year, both scopes."""
    hours = tiers.rollup(fx.view(spark, sf, "traffic_wide"), "hour", fx.WIDE_NOW, TZ)
    days = tiers.rollup(hours, "day", fx.WIDE_NOW, TZ)
    window = (datetime(2000, 1, 1, 5), datetime(2001, 1, 1, 5))
    return fact_rows(verbs.series(days, identities(spark, sf), 11, window, scope="all"))


IDENTITY_COLUMNS = ("id", "host", "uid", "unit_or_cgroup", "exe", "project_root", "normalized_cmdline", "comm", "username")


@check(oracle(f"""SELECT {', '.join(IDENTITY_COLUMNS)} FROM identity_wide
  WHERE contains(exe, 'p1') OR contains(project_root, 'p1') OR contains(coalesce(comm, ''), 'p1')
  UNION ALL SELECT {', '.join(IDENTITY_COLUMNS)} FROM identity_wide WHERE contains(coalesce(comm, ''), 'c_')""", "identity_wide"))
def list_identities(spark, sf):
    """Two searches; the underscore of the second one is no wildcard."""
    identity = identities(spark, sf)
    found = verbs.list_identities(identity, "p1").unionByName(verbs.list_identities(identity, "c_"))
    return found.select(*IDENTITY_COLUMNS)


@check(oracle(f"""SELECT {', '.join(IDENTITY_COLUMNS)}, raw_cmdline, {ms('first_seen', 'first_ms')}, {ms('last_seen', 'last_ms')}
  FROM identity_wide WHERE id = 7""", "identity_wide"))
def show_identity(spark, sf):
    return verbs.show_identity(identities(spark, sf), 7).select(
        *IDENTITY_COLUMNS, "raw_cmdline", as_ms("first_seen", "first_ms"), as_ms("last_seen", "last_ms")
    )


NOW = datetime(2001, 11, 4, 21, 30, tzinfo=timezone.utc)
WINDOWS = {
    "since 5h": dict(since=timedelta(hours=5)),
    "since 24h": dict(since=timedelta(hours=24)),
    "today": dict(preset="today"),
    "this-month": dict(preset="this-month"),
    "from-to": dict(start=datetime(2001, 10, 10, tzinfo=timezone.utc), end=datetime(2001, 10, 25, tzinfo=timezone.utc)),
}
BOUNDS = {
    "since 5h": ("2001-11-04 16:30:00", "2001-11-04 21:30:00"),
    "since 24h": ("2001-11-03 21:30:00", "2001-11-04 21:30:00"),
    "today": ("2001-11-04 05:00:00", "2001-11-04 21:30:00"),
    "this-month": ("2001-11-01 05:00:00", "2001-11-04 21:30:00"),
    "from-to": ("2001-10-10 00:00:00", "2001-10-25 00:00:00"),
    **{f"since {n}d": (str(datetime(2001, 11, 4, 21, 30) - timedelta(days=n)), "2001-11-04 21:30:00") for n in (31, 32, 45, 60)},
}
WINDOWS |= {f"since {n}d": dict(since=timedelta(days=n)) for n in (31, 32, 45, 60)}
# an edge whose minutes are gone is widened to its hour
WIDENED = {"2001-10-04 21:30:00": "2001-10-04 21:00:00", "2001-10-03 21:30:00": "2001-10-03 21:00:00",
           "2001-09-20 21:30:00": "2001-09-20 21:00:00", "2001-09-05 21:30:00": "2001-09-05 21:00:00"}


def bounded_sql(bounds: dict[str, tuple[str, str]]) -> str:
    return oracle(" UNION ALL ".join(
        f"""SELECT '{name}' AS asked, {ms(f"TIMESTAMP '{start}'", 'from_ms')}, {ms(f"TIMESTAMP '{end}'", 'to_ms')}, {SUMS}
  FROM traffic_wide WHERE scope = 'external' AND bucket >= TIMESTAMP '{start}' AND bucket < TIMESTAMP '{end}'"""
        for name, (start, end) in bounds.items()), "traffic_wide")


def answered(name: str, window: tuple[datetime, datetime], total):
    return total.select(
        F.lit(name).alias("asked"), F.lit(int(window[0].timestamp() * 1000)).alias("from_ms"),
        F.lit(int(window[1].timestamp() * 1000)).alias("to_ms"), "ingress_bytes", "egress_bytes")


@check(bounded_sql(BOUNDS))
def time_window(spark, sf):
    """Each way to say a window: its bounds and its bytes, from the tiers that fit, rolled up an hour ago."""
    tier_facts = {"minute": everything(spark, sf)}
    rolled = {}
    for tier, finer in FINER.items():
        tier_facts[tier] = tiers.rollup(tier_facts[finer], tier, NOW - timedelta(hours=1), TZ)
        rolled[tier] = tiers.closed_bound(tier, NOW - timedelta(hours=1), TZ)
    result = None
    for name, asked in WINDOWS.items():
        window = verbs.time_window(NOW, TZ, **asked)
        tier = verbs.pick_tier(window, NOW, SETTINGS, preset=asked.get("preset"))
        pieces = verbs.window_pieces(window, tier, SETTINGS, rolled, {})
        rows = reduce(DataFrame.unionByName, [verbs.in_window(tier_facts[t], (a, b)) for t, a, b in pieces])
        row = answered(name, window, verbs.in_scope(rows).agg(*tiers.byte_sums()))
        result = row if result is None else result.unionByName(row)
    return result


@check(bounded_sql({name: (WIDENED.get(start, start), end) for name, (start, end) in BOUNDS.items()}))
def window_answer(spark, sf):
    """The same questions to a store after rollup and retention, answered over the window that is left."""
    store = Store(spark, work_dir(spark, "window"))
    store.append("minute", everything(spark, sf), "all")
    store.stage_identities(identities(spark, sf), "all")
    store.commit_batches([(IDENTITY_TABLE, "all")])
    store.maintain(NOW - timedelta(hours=1), SETTINGS)
    reader = Reader(store, SETTINGS, caller_uid=0)
    result = None
    for name, asked in WINDOWS.items():
        question = Asked(NOW, **asked)
        total = reader.top(question, limit=None).agg(*tiers.byte_sums())
        row = answered(name, reader.effective(question), total)
        result = row if result is None else result.unionByName(row)
    return result


@check(oracle(f"""SELECT 'default' AS asked, {FACT} FROM traffic_wide WHERE scope = 'external'
  UNION ALL SELECT 'loopback', {FACT} FROM traffic_wide WHERE scope = 'loopback'
  UNION ALL SELECT 'all', {FACT} FROM traffic_wide""", "traffic_wide"))
def scope_filter(spark, sf):
    rows = everything(spark, sf)
    views = [
        fact_rows(verbs.in_scope(rows, scope), F.lit(name).alias("asked"))
        for name, scope in (("default", None), ("loopback", "loopback"), ("all", "all"))
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


def seen_by(name: str, predicate: str) -> str:
    return f"""SELECT '{name}' AS caller, i.host, i.id AS group_key, {SUMS} FROM traffic_wide f
  JOIN identity_wide i ON i.id = f.identity_id WHERE scope = 'external' AND {predicate} GROUP BY i.host, i.id"""


@check(oracle(" UNION ALL ".join([
    seen_by("user 1007 of h1", "i.uid = 1007 AND i.host = 'h1'"), seen_by("user 1007 of h2", "i.uid = 1007 AND i.host = 'h2'"),
    seen_by("root", "TRUE"), seen_by("root for 1003", "i.uid = 1003"), seen_by("admin 1007", "TRUE"),
    seen_by("admin 1007 for 1003", "i.uid = 1003"), seen_by("user 1007 of h1 for 1003", "i.uid = 1007 AND i.host = 'h1'")]),
    "traffic_wide", "identity_wide"))
def uid_scope(spark, sf):
    """One user number on two hosts, root, a configured admin, both of them narrowing; a user cannot."""
    rows, identity = verbs.in_scope(everything(spark, sf)), identities(spark, sf)
    admins = replace(SETTINGS, admin_uids=(1007,))
    callers = {
        "user 1007 of h1": dict(caller_uid=1007, caller_host="h1"),
        "user 1007 of h2": dict(caller_uid=1007, caller_host="h2"),
        "root": dict(caller_uid=0, settings=admins),
        "root for 1003": dict(caller_uid=0, uid=1003, settings=admins),
        "admin 1007": dict(caller_uid=1007, settings=admins),
        "admin 1007 for 1003": dict(caller_uid=1007, uid=1003, settings=admins),
        "user 1007 of h1 for 1003": dict(caller_uid=1007, caller_host="h1", uid=1003),
    }
    result = None
    for name, who in callers.items():
        visible = verbs.visible(identity, **{"settings": SETTINGS, **who})
        seen = verbs.grouped(rows, visible, "identity", narrowed=name not in ("root", "admin 1007"))
        part = seen.select(F.lit(name).alias("caller"), "host", "group_key", "ingress_bytes", "egress_bytes")
        result = part if result is None else result.unionByName(part)
    return result


@check(oracle(f"""SELECT {', '.join(IDENTITY_COLUMNS)} FROM identity_wide
  WHERE id IN (SELECT identity_id FROM traffic_wide WHERE scope = 'loopback')""", "traffic_wide", "identity_wide"))
def referenced_identities(spark, sf):
    counters = verbs.counter_rows(verbs.in_scope(everything(spark, sf), "loopback"))
    return verbs.referenced_identities(counters, identities(spark, sf)).select(*IDENTITY_COLUMNS)


@check(oracle(f"""SELECT identity_id, {ms('bucket', 'bucket_unix_ms')}, scope, ingress_bytes, egress_bytes
  FROM traffic_wide""", "traffic_wide"))
def counter_rows(spark, sf):
    return verbs.counter_rows(everything(spark, sf))


@check(oracle(f"""SELECT i.host, CAST(i.uid AS VARCHAR) AS group_key, {', '.join(
  f"CAST(sum(CASE WHEN (i.exe = '<unresolved>') = {flag} THEN {side}_bytes ELSE 0 END) AS BIGINT) AS {name}_{side}_bytes"
  for name, flag in (('resolved', 'FALSE'), ('unresolved', 'TRUE')) for side in ('ingress', 'egress'))}
  FROM traffic_wide f JOIN identity_wide i ON i.id = f.identity_id WHERE scope = 'external'
  GROUP BY i.host, i.uid""", "traffic_wide", "identity_wide"))
def unresolved_share(spark, sf):
    return verbs.unresolved_share(everything(spark, sf), identities(spark, sf))
