"""Streams run to their end and compared with what they mean as a batch."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from bytewake.config import FINER, NATURAL_KEY, Settings
from bytewake.plans.attribution import ingest
from bytewake.plans.reader import Reader
from bytewake.plans.reconcile import reconcile
from bytewake.session import work_dir
from bytewake.sources.store import Store
from bytewake.streaming import live
from checks import fixtures as fx
from checks.fixtures import KEY, PAIR, TZ, ms, oracle
from checks.identity_checks import feeds
from checks.registry import as_ms, as_us, check, fact_rows

SETTINGS = Settings(tz=TZ)
DELAY = timedelta(minutes=2)
# Minutes the watermark has passed once all samples are read.
CLOSED = "date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM moved) - INTERVAL 2 MINUTE"
MINUTE = ms("date_trunc('minute', ts)", "bucket_ms")


# Where micro-batches end: inside minutes, and elsewhere in a second run.
BORDERS = ("2024-01-09 11:20:30", "2024-01-21 04:00:15.5")
OTHERS = ("2024-01-15 18:45:50",)


def run(writer, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drained(spark, stream, label: str):
    """All rows an append-mode stream emits, as a table."""
    folder = work_dir(spark, label)
    run(stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows"), f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@check(oracle(f"""SELECT {MINUTE}, host, tgid, scope, {PAIR}, CAST(min(epoch_us(ts)) AS BIGINT) AS min_us
  FROM moved WHERE {CLOSED} GROUP BY ALL""", "moved"))
def stream_minute_fold(spark, sf):
    rows = drained(spark, live.stream_minute_fold(fx.sample_stream(spark, sf, *BORDERS), DELAY), "stream")
    return rows.select(
        as_ms("bucket", "bucket_ms"), "host", "tgid", "scope", "ingress_bytes", "egress_bytes", as_us("min_ts", "min_us")
    )


@check(oracle("SELECT DISTINCT host, tgid FROM moved", "moved"))
def stream_first_sight(spark, sf):
    rows = drained(spark, live.stream_first_sight(fx.sample_stream(spark, sf, *OTHERS), DELAY), "sight")
    return rows.select("host", "tgid").distinct()


@check(oracle(f"""SELECT {MINUTE}, host, tgid AS identity_id, scope, {PAIR} FROM moved WHERE {CLOSED} GROUP BY ALL""", "moved"))
def idempotent_commit(spark, sf):
    """The stream runs twice under one name, in other micro-batches the second time; every counter counts once."""
    store = Store(spark, work_dir(spark, "twice"))
    for attempt, borders in (("a", BORDERS), ("b", OTHERS)):
        facts = live.stream_minute_fold(fx.sample_stream(spark, sf, *borders), DELAY).select(
            "bucket", F.col("tgid").alias("identity_id"), "scope", "ingress_bytes", "egress_bytes"
        )
        sink = live.idempotent_commit(store, "minute", "samples")
        run(facts.writeStream.outputMode("append").foreachBatch(sink), f"{store.root}/state-{attempt}")
    host = F.concat(F.lit("h"), (F.col("identity_id") % 4).cast("string")).alias("host")
    return fact_rows(store.scan("minute"), host)


@check(oracle(f"""SELECT * FROM (SELECT {MINUTE}, host, exe AS group_key, scope, {PAIR} FROM attributed WHERE scope = 'loopback' GROUP BY ALL) g
  QUALIFY row_number() OVER (PARTITION BY bucket_ms ORDER BY ingress_bytes + egress_bytes DESC, host, group_key) <= 5""",
  "attributed"))
def stream_watch(spark, sf):
    """The last ranking emitted for every minute."""
    folder = work_dir(spark, "watch")
    known = feeds(spark, sf)

    reader = Reader(Store(spark, f"{folder}/store"), SETTINGS, caller_uid=0)

    def emit(ranked, number):
        ranked.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/trigger={number}")

    watching = reader.watch(fx.sample_stream(spark, sf, *BORDERS), lambda: known, emit, DELAY, "exe", 5, "loopback")
    run(watching, f"{folder}/state")
    rows = spark.read.parquet(f"{folder}/rows")
    latest = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["bucket", "batch"]).select(
        as_ms("bucket", "bucket_ms"), "host", "group_key", F.lit("loopback").alias("scope"), "ingress_bytes", "egress_bytes"
    )


HOUR = ms("date_trunc('hour', ts)", "bucket_ms")


@check(oracle(f"SELECT {HOUR}, {KEY}, scope, {PAIR} FROM attributed WHERE ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY ALL",
              "attributed"))
def late_samples(spark, sf):
    """One host delivers only after its hours were rolled up."""
    store = Store(spark, work_dir(spark, "late"))
    everything = feeds(spark, sf)
    punctual = replace(everything, samples=everything.samples.where(F.col("host") != "h3"))
    ingest(spark, store, punctual, "punctual", SETTINGS)
    for tier in FINER:
        store.rollup(tier, fx.SAMPLES_NOW, SETTINGS)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    reconcile(spark, store, everything, "late", start, fx.SAMPLES_NOW, SETTINGS)
    names = store.identities().select(F.col("id").alias("identity_id"), *NATURAL_KEY)
    return store.scan("hour").join(names, "identity_id").select(
        as_ms("bucket", "bucket_ms"), *NATURAL_KEY, "scope", "ingress_bytes", "egress_bytes"
    )


@check(oracle(f"SELECT {MINUTE}, {KEY}, scope, {PAIR} FROM attributed WHERE {CLOSED} GROUP BY ALL", "attributed"))
def stream_ingest(spark, sf):
    """Stream to store, all the way to identities; a minute in which a number changes hands is split at the millisecond."""
    store = Store(spark, work_dir(spark, "live"))
    known = feeds(spark, sf)
    run(live.ingest_stream(store, fx.sample_stream(spark, sf, *OTHERS), lambda: known, DELAY, "live", SETTINGS,
                           slices=timedelta(milliseconds=1)), f"{store.root}/state")
    names = store.identities().select(F.col("id").alias("identity_id"), *NATURAL_KEY)
    return store.scan("minute").join(names, "identity_id").select(
        as_ms("bucket", "bucket_ms"), *NATURAL_KEY, "scope", "ingress_bytes", "egress_bytes"
    )
