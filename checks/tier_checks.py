"""Tier storage: merge, rollup, watermark, retention, constraints, files."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from bytewake import schemas
from bytewake.config import FINER, TIERS, Settings
from bytewake.functions import calendar
from bytewake.operators import identity as ids
from bytewake.operators import samples as smp
from bytewake.operators import tiers
from bytewake.session import work_dir
from bytewake.sources import landing
from bytewake.sources.store import Store
from bytewake.staging import stage_in
from checks import fixtures as fx
from checks.fixtures import SUMS, TZ, ms, oracle, us
from checks.registry import as_us, check, fact_rows

SETTINGS = Settings(tz=TZ)
FACT = f"{ms('bucket', 'bucket_ms')}, identity_id, scope, ingress_bytes, egress_bytes"
ROLLUP_RUNS = (
    datetime(2024, 1, 9, 12, 34, 56, tzinfo=timezone.utc),
    datetime(2024, 1, 22, 3, 0, tzinfo=timezone.utc),
    datetime(2024, 1, 31, tzinfo=timezone.utc),
)

# Minute facts of the samples with the process number as identity id.
PROCESS_MINUTES = """SELECT date_trunc('minute', ts) AS bucket, tgid AS identity_id, scope,
  CAST(sum(CASE WHEN dir = 'ingress' THEN bytes ELSE 0 END) AS BIGINT) AS ingress_bytes,
  CAST(sum(CASE WHEN dir = 'egress' THEN bytes ELSE 0 END) AS BIGINT) AS egress_bytes FROM moved GROUP BY 1, 2, 3"""


def process_minutes(samples):
    return smp.minute_fold(samples).groupBy("bucket", F.col("tgid").alias("identity_id"), "scope").agg(
        *tiers.byte_sums()
    )


def sample_store(spark, sf, label) -> tuple[Store, object]:
    return Store(spark, work_dir(spark, label)), process_minutes(fx.samples(spark, sf))


# -- sources and sinks ------------------------------------------------------

@check(oracle(f"""SELECT sample_id, {us('ts', 'ts_us')}, host, tgid, hook, ret, family, daddr_hex, saddr_hex
  FROM socket_sample WHERE ts >= TIMESTAMP '2024-01-08 06:30:00' AND ts < TIMESTAMP '2024-01-23 18:00:00'""", "socket_sample"))
def scan_samples(spark, sf):
    """A window of a landing folder, read from the folders of its dates."""
    path = work_dir(spark, "samples")
    landing.land_samples(fx.samples(spark, sf), path)
    window = (datetime(2024, 1, 8, 6, 30), datetime(2024, 1, 23, 18))
    return landing.scan_samples(spark, path, window=window).select(
        "sample_id", as_us("ts", "ts_us"), "host", "tgid", "hook", "ret", "family",
        F.hex("daddr").alias("daddr_hex"), F.hex("saddr").alias("saddr_hex"),
    )


@check(oracle(f"SELECT host, tgid, {us('seen_at', 'seen_us')}, exe, cwd, comm, cmdline, status, cgroup FROM proc_snapshot",
              "proc_snapshot"))
def scan_proc_snapshots(spark, sf):
    path = work_dir(spark, "snapshots")
    fx.view(spark, sf, "proc_snapshot").write.parquet(path)
    return landing.scan_proc_snapshots(spark, path).withColumn("seen_us", F.unix_micros("seen_at")).drop("seen_at")


@check(oracle(f"SELECT host, tgid, uid, cgroup_id, comm, {us('captured_at', 'captured_us')} FROM pid_meta", "pid_meta"))
def scan_pid_meta(spark, sf):
    """Every capture lands twice, the second time late and changed; of one lifetime the earlier wins."""
    path = work_dir(spark, "meta")
    meta = fx.view(spark, sf, "pid_meta")
    again = meta.withColumn("comm", F.lit("renamed")).withColumn("captured_at", F.col("captured_at") + F.expr("INTERVAL 2 SECONDS"))
    again.unionByName(meta).write.parquet(path)
    # lifetimes as the captures themselves open them
    marks = meta.select("host", "tgid", F.col("captured_at").alias("seen_at"))
    first = landing.first_capture(ids.captures(landing.scan_pid_meta(spark, path), marks))
    return first.select("host", "tgid", "uid", "cgroup_id", "comm", as_us("captured_at", "captured_us"))


@check(oracle(f"SELECT {FACT}, strftime(bucket, '%Y-%m-%d') AS dt, 'b1' AS batch_id FROM facts",
              "moved", facts=PROCESS_MINUTES))
def tier_sink(spark, sf):
    store, facts = sample_store(spark, sf, "sink")
    store.append("minute", facts, "b1")
    written = spark.read.schema(schemas.TRAFFIC_STORED).parquet(f"{store.root}/traffic_minute")
    # a folder is named after the batch and the attempt
    batch = F.substring_index("batch_id", ".", 1).alias("batch_id")
    return fact_rows(written, F.col("dt").cast("string").alias("dt"), batch)


@check(oracle(f"""SELECT {FACT} FROM facts WHERE scope = 'external'
  AND bucket >= TIMESTAMP '2024-01-10 06:30:00' AND bucket < TIMESTAMP '2024-01-20 18:00:00'""",
  "moved", facts=PROCESS_MINUTES))
def tier_scan(spark, sf):
    """A window and scope out of two committed deltas, one of them compacted, and one uncommitted."""
    store, facts = sample_store(spark, sf, "scan")
    facts = stage_in(spark, "scan")(facts, "facts")
    store.append("minute", facts.where(F.col("ingress_bytes") > 0), "received")
    store.append("minute", facts.where(F.col("ingress_bytes") == 0), "sent")
    store.stage("minute", facts, "orphan")
    store.compact("minute", datetime(2024, 1, 12).date())
    window = (datetime(2024, 1, 10, 6, 30), datetime(2024, 1, 20, 18))
    return fact_rows(store.scan("minute", *window, scope="external"))


@check(oracle(f"SELECT {FACT} FROM facts", "moved", facts=PROCESS_MINUTES))
def json_sink(spark, sf):
    path = work_dir(spark, "json")
    landing.json_sink(fact_rows(process_minutes(fx.samples(spark, sf))), path)
    schema = "bucket_ms long, identity_id long, scope string, ingress_bytes long, egress_bytes long"
    return spark.read.schema(schema).json(path)


# -- merge and rollup -------------------------------------------------------

@check(oracle(f"SELECT {FACT} FROM traffic_wide", "traffic_wide"))
def minute_merge(spark, sf):
    """Two deltas that share keys add up to the whole."""
    lines = fx.table(spark, sf, "lineitem")
    deltas = [
        fx.view(spark, sf, "traffic_wide", lineitem=lines.where(F.col("l_linestatus") == status))
        for status in ("O", "F")
    ]
    return fact_rows(tiers.minute_merge(*deltas))


@check(oracle(f"SELECT {FACT} FROM hours", "hours"))
def rollup_hour(spark, sf):
    return fact_rows(tiers.rollup(fx.view(spark, sf, "traffic_wide"), "hour", fx.WIDE_NOW, TZ))


@check(oracle(f"SELECT {FACT} FROM days", "days"))
def rollup_day(spark, sf):
    hours = tiers.rollup(fx.view(spark, sf, "traffic_wide"), "hour", fx.WIDE_NOW, TZ)
    return fact_rows(tiers.rollup(hours, "day", fx.WIDE_NOW, TZ))


@check(oracle(f"SELECT {FACT} FROM months", "months"))
def rollup_month(spark, sf):
    hours = tiers.rollup(fx.view(spark, sf, "traffic_wide"), "hour", fx.WIDE_NOW, TZ)
    days = tiers.rollup(hours, "day", fx.WIDE_NOW, TZ)
    return fact_rows(tiers.rollup(days, "month", fx.WIDE_NOW, TZ))


LOCAL = "(date_trunc('{unit}', (bucket AT TIME ZONE 'UTC') AT TIME ZONE '" + TZ + "') AT TIME ZONE '" + TZ + "') AT TIME ZONE 'UTC'"
RUNS = {
    "facts": PROCESS_MINUTES,
    "h": f"""SELECT date_trunc('hour', bucket) AS bucket, identity_id, scope, {SUMS} FROM facts
  WHERE bucket < TIMESTAMP '2024-01-31 00:00:00' GROUP BY 1, 2, 3""",
    "d": f"SELECT {LOCAL.format(unit='day')} AS bucket, identity_id, scope, {SUMS} FROM h GROUP BY 1, 2, 3",
    "m": f"""SELECT {LOCAL.format(unit='month')} AS bucket, identity_id, scope, {SUMS} FROM d
  WHERE bucket < TIMESTAMP '2024-01-30 05:00:00' GROUP BY 1, 2, 3""",
}


@check(oracle(f"""SELECT 'hour' AS tier, {ms("TIMESTAMP '2024-01-31 00:00:00'", 'rolled_through_ms')}, {FACT} FROM h
  UNION ALL SELECT 'day', {ms("TIMESTAMP '2024-01-31 00:00:00'", 'rolled_through_ms')}, {FACT} FROM d
  UNION ALL SELECT 'month', {ms("TIMESTAMP '2024-01-30 05:00:00'", 'rolled_through_ms')}, {FACT} FROM m""",
  "moved", **RUNS))
def rollup_watermark(spark, sf):
    """Rolling up after every gap, twice each, gives what one run would."""
    store, facts = sample_store(spark, sf, "watermark")
    store.append("minute", facts, "b1")
    for now in ROLLUP_RUNS:
        for _ in range(2):
            for tier in FINER:
                store.rollup(tier, now, SETTINGS)
    views = [
        fact_rows(store.scan(tier), F.lit(tier).alias("tier"),
                  F.lit(calendar.micros(store.watermark(tier)) // 1000).alias("rolled_through_ms"))
        for tier in FINER
    ]
    return views[0].unionByName(views[1]).unionByName(views[2])


KEPT = {
    "minute": ("traffic_wide", "2001-11-03 00:00:00"),
    "hour": ("hours", "2001-08-07 00:00:00"),
    "day": ("days", "1999-11-06 00:00:00"),
    "month": ("months", "1990-01-01 00:00:00"),
}


@check(oracle(" UNION ALL ".join(
    f"SELECT '{tier}' AS tier, {FACT} FROM {source} WHERE bucket >= TIMESTAMP '{bound}'"
    for tier, (source, bound) in KEPT.items()), "months"))
def prune_retention(spark, sf):
    """Every tier after retention; what was not rolled up yet stays."""
    facts = {"minute": fx.view(spark, sf, "traffic_wide")}
    for tier, finer in FINER.items():
        facts[tier] = tiers.rollup(facts[finer], tier, fx.WIDE_NOW, TZ)
    kept = []
    for tier in TIERS:
        coarser = {fine: coarse for coarse, fine in FINER.items()}.get(tier)
        rolled = tiers.closed_bound(coarser, fx.WIDE_NOW, TZ) if coarser else None
        rows = tiers.prune_retention(facts[tier], tier, fx.WIDE_NOW, SETTINGS, rolled)
        kept.append(fact_rows(rows, F.lit(tier).alias("tier")))
    result = kept[0]
    for rows in kept[1:]:
        result = result.unionByName(rows)
    return result


BROKEN = """SELECT l_shipdate AS bucket, nullif(l_suppkey, 7) AS identity_id,
  CASE l_returnflag WHEN 'R' THEN 'loopback' WHEN 'A' THEN 'external' ELSE 'lan' END AS scope,
  CAST(l_quantity AS BIGINT) AS ingress_bytes, CASE WHEN l_linenumber < 7 THEN CAST(l_extendedprice AS BIGINT) END AS egress_bytes
  FROM {lineitem}"""
MARKS = """SELECT CASE o_orderstatus WHEN 'O' THEN 'hour' WHEN 'F' THEN 'day' ELSE 'week' END AS tier,
  o_orderdate AS rolled_up_through FROM {orders}"""
TWINS = "SELECT * FROM identity_wide WHERE id % 50 <> 49 UNION ALL SELECT * FROM identity_wide WHERE id % 20 = 3"


@check(oracle("""SELECT 'scope_domain' AS rule, CAST(count(*) AS BIGINT) AS violations FROM facts WHERE scope NOT IN ('external', 'loopback')
  UNION ALL SELECT 'not_null', count(*) FROM facts WHERE bucket IS NULL OR identity_id IS NULL OR scope IS NULL
    OR ingress_bytes IS NULL OR egress_bytes IS NULL
  UNION ALL SELECT 'tier_key', count(*) FROM (SELECT 1 FROM facts WHERE identity_id IS NOT NULL
    GROUP BY bucket, identity_id, scope HAVING count(*) > 1)
  UNION ALL SELECT 'identity_reference', count(*) FROM facts f WHERE identity_id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM twins t WHERE t.id = f.identity_id)
  UNION ALL SELECT 'watermark_tier', count(*) FROM marks WHERE tier NOT IN ('hour', 'day', 'month')
  UNION ALL SELECT 'natural_key', count(*) FROM (SELECT 1 FROM twins
    GROUP BY host, uid, unit_or_cgroup, exe, project_root, normalized_cmdline HAVING count(*) > 1)""",
  "identity_wide", facts=BROKEN.replace("{lineitem}", "lineitem"), twins=TWINS, marks=MARKS.replace("{orders}", "orders")))
def tier_constraints(spark, sf):
    facts = spark.sql(BROKEN, lineitem=fx.table(spark, sf, "lineitem"))
    marks = spark.sql(MARKS, orders=fx.table(spark, sf, "orders"))
    identity = fx.view(spark, sf, "identity_wide")
    twins = identity.where(F.col("id") % 50 != 49).unionByName(identity.where(F.col("id") % 20 == 3))
    return tiers.tier_violations(facts, twins).unionByName(tiers.watermark_violations(marks))
