"""Sample preparation: filters, classification, folds."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from bytewake.functions import calendar
from bytewake.functions.network import direction_of_hook, scope_of
from bytewake.operators import samples as smp
from checks import fixtures as fx
from checks.fixtures import PAIR, ms, oracle, us
from checks.registry import as_ms, as_us, check

MINUTE = ms("date_trunc('minute', ts)", "bucket_ms")
OPEN_MINUTE = datetime(2024, 1, 20, 12, 34, 56, tzinfo=timezone.utc)


@check(oracle("SELECT sample_id, host, tgid, ret FROM socket_sample WHERE ret > 0", "socket_sample"))
def positive_bytes(spark, sf):
    return smp.positive_bytes(fx.samples(spark, sf)).select("sample_id", "host", "tgid", "ret")


@check(oracle("""SELECT sample_id, hook, CASE WHEN hook IN ('tcp_sendmsg', 'udp_sendmsg', 'udpv6_sendmsg') THEN 'egress'
  WHEN hook IN ('tcp_cleanup_rbuf', 'udp_recvmsg', 'udpv6_recvmsg') THEN 'ingress' END AS dir FROM socket_sample""",
  "socket_sample"), name="direction_of_hook")
def hook_directions(spark, sf):
    return fx.samples(spark, sf).select("sample_id", "hook", direction_of_hook(F.col("hook")).alias("dir"))


@check(oracle("SELECT sample_id, scope FROM moved", "moved"))
def scope_classify(spark, sf):
    rows = smp.positive_bytes(fx.samples(spark, sf))
    return rows.select("sample_id", scope_of(F.col("family"), F.col("daddr"), F.col("saddr")).alias("scope"))


@check(oracle(f"""SELECT host, tgid, {us('ts', 'first_us')}, sample_id, hook FROM socket_sample
  QUALIFY row_number() OVER (PARTITION BY host, tgid ORDER BY ts, sample_id) = 1""", "socket_sample"))
def first_sight(spark, sf):
    first = smp.first_sight(fx.samples(spark, sf), ["ts", "sample_id", "hook"], ["ts", "sample_id"])
    return first.select("host", "tgid", as_us("ts", "first_us"), "sample_id", "hook")


@check(oracle("SELECT host, tgid, dir, scope, CAST(sum(bytes) AS BIGINT) AS bytes FROM moved GROUP BY ALL", "moved"))
def counter_fold(spark, sf):
    return smp.counter_fold(smp.transfers(fx.samples(spark, sf)))


@check(oracle(f"SELECT sample_id, {MINUTE} FROM socket_sample",
              "socket_sample"))
def minute_bucket(spark, sf):
    rows = fx.samples(spark, sf).withColumn("bucket", calendar.minute_start(F.col("ts")))
    return rows.select("sample_id", as_ms("bucket", "bucket_ms"))


@check(oracle(f"SELECT {MINUTE}, host, tgid, scope, {PAIR} "
              "FROM moved GROUP BY ALL", "moved"))
def direction_pivot(spark, sf):
    moved = smp.transfers(fx.samples(spark, sf)).withColumn("bucket", calendar.minute_start(F.col("ts")))
    folded = smp.direction_pivot(moved, "bucket", "host", "tgid", "scope")
    return folded.select(as_ms("bucket", "bucket_ms"), "host", "tgid", "scope", "ingress_bytes", "egress_bytes")


@check(oracle(f"SELECT {MINUTE}, host, tgid, scope, {PAIR} "
              "FROM moved WHERE ts < TIMESTAMP '2024-01-20 12:34:00' GROUP BY ALL", "moved"))
def flush_closed_minutes(spark, sf):
    closed = smp.closed_minute_fold(fx.samples(spark, sf), OPEN_MINUTE)
    return closed.select(as_ms("bucket", "bucket_ms"), "host", "tgid", "scope", "ingress_bytes", "egress_bytes")
