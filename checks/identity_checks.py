"""Attribution: cleaning, lookups, lifetimes, the dimension."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from bytewake.config import DISPLAY, NATURAL_KEY
from bytewake.functions import calendar
from bytewake.operators import identity as ids
from bytewake.operators import verbs
from bytewake.operators.tiers import byte_sums
from bytewake.plans.attribution import LIFETIME, Feeds, lifetime_folds, minute_facts, sightings
from bytewake.staging import stage_in
from checks import fixtures as fx
from checks.fixtures import DISPLAYED, KEY, PAIR, ms, oracle, us
from checks.registry import as_ms, as_us, check


def feeds(spark, sf, **replaced) -> Feeds:
    return Feeds(
        samples=fx.samples(spark, sf, **replaced),
        snapshots=fx.view(spark, sf, "proc_snapshot"),
        meta=fx.view(spark, sf, "pid_meta"),
        passwd=fx.view(spark, sf, "passwd"),
        markers=fx.view(spark, sf, "project_marker"),
    )


def records(spark, sf):
    f = feeds(spark, sf)
    return ids.snapshot_records(f.snapshots, f.passwd, f.markers)


def snapshot_sightings(rows):
    """A sighting per snapshot, in order of time and process number."""
    return rows.withColumn("first_seen", F.col("seen_at")).withColumn("last_seen", F.col("seen_at")).withColumn(
        "seq", F.col("tgid")
    )


@check(oracle(f"SELECT host, tgid, {us('seen_at', 'seen_us')}, exe, cwd, comm, raw_cmdline, uid, unit_or_cgroup FROM clean",
              "clean"))
def proc_fields(spark, sf):
    clean = ids.proc_fields(fx.view(spark, sf, "proc_snapshot"))
    return clean.select(
        "host", "tgid", as_us("seen_at", "seen_us"), "exe", "cwd", "comm", "raw_cmdline", "uid", "unit_or_cgroup"
    )


@check(oracle("""SELECT DISTINCT c.host, c.cwd, coalesce(r.project_root, '<none>') AS project_root
  FROM clean c LEFT JOIN roots r ON r.host = c.host AND r.cwd = c.cwd""", "clean", "roots"))
def project_root(spark, sf):
    directories = fx.view(spark, sf, "proc_snapshot").select("host", "cwd").distinct()
    return ids.with_project_root(directories, fx.view(spark, sf, "project_marker")).select(
        "host", "cwd", "project_root"
    )


@check(oracle("SELECT c.host, c.tgid, c.raw_cmdline, k.normalized_cmdline FROM clean c "
              "JOIN masked k ON k.raw_cmdline = c.raw_cmdline", "clean", "masked"))
def normalize_cmdline(spark, sf):
    from bytewake.functions.process import normalize_cmdline as normalized

    clean = ids.proc_fields(fx.view(spark, sf, "proc_snapshot"))
    return clean.select(
        "host", "tgid", "raw_cmdline", normalized(F.col("raw_cmdline")).alias("normalized_cmdline")
    )


@check(oracle("SELECT c.host, c.tgid, c.uid, n.username FROM clean c "
              "LEFT JOIN names n ON n.host = c.host AND n.uid = c.uid", "clean", "names"))
def username_lookup(spark, sf):
    clean = ids.proc_fields(fx.view(spark, sf, "proc_snapshot"))
    return ids.with_username(clean, fx.view(spark, sf, "passwd")).select("host", "tgid", "uid", "username")


@check(oracle(f"SELECT tgid, {us('gen_start', 'gen_us')}, {KEY}, {DISPLAYED} FROM degraded", "degraded"))
def unresolved_from_meta(spark, sf):
    """Some process numbers are captured twice, with and without snapshots."""
    f = feeds(spark, sf)
    return ids.meta_records(f.captures(), f.passwd).withColumn("gen_us", F.unix_micros("gen_start")).drop("gen_start")


@check(oracle(f"""SELECT host, tgid, coalesce(CAST(epoch_us(gen_start) AS BIGINT), -1) AS gen_us, scope, {PAIR},
  CAST(min(epoch_us(ts)) AS BIGINT) AS min_us, CAST(max(epoch_us(ts)) AS BIGINT) AS max_us
  FROM placed GROUP BY host, tgid, gen_start, scope""", "placed"))
def tgid_lifetime(spark, sf):
    stage = stage_in(spark, "lifetimes")
    folds = lifetime_folds(feeds(spark, sf), stage)
    lives = folds.groupBy(*LIFETIME, "scope").agg(
        *byte_sums(), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")
    )
    # -1: a process without any snapshot or capture
    started = F.coalesce(F.unix_micros("gen_start"), F.lit(-1)).alias("gen_us")
    return lives.select(
        "host", "tgid", started, "scope", "ingress_bytes", "egress_bytes",
        as_us("min_ts", "min_us"), as_us("max_ts", "max_us"),
    )


@check(oracle(f"SELECT {KEY}, source, {PAIR} FROM attributed GROUP BY {KEY}, source", "attributed"))
def resolve_chain(spark, sf):
    f = feeds(spark, sf)
    folds = lifetime_folds(f, stage_in(spark, "resolve"))
    lives = folds.groupBy(*LIFETIME).agg(*byte_sums())
    resolved = ids.resolve_chain(
        lives, ids.snapshot_records(f.snapshots, f.passwd, f.markers), ids.meta_records(f.captures(), f.passwd)
    )
    keys = [F.col(f"record.{c}").alias(c) for c in NATURAL_KEY[1:]]
    return resolved.groupBy("host", *keys, "source").agg(*byte_sums())


NUMBERED = f"row_number() OVER (ORDER BY CAST(first_seen AS DATE), md5(concat_ws(chr(31), {KEY})), {KEY})"

UPSERT = {
    "batch": f"""SELECT tgid, seen_at, CASE WHEN seen_at < TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 2 END AS b,
  {KEY}, comm, raw_cmdline,
  CASE WHEN seen_at >= TIMESTAMP '2024-01-16 00:00:00' AND uid % 7 = 0 THEN NULL ELSE username END AS username FROM live""",
    "keyed": f"""SELECT {KEY}, min(b) AS b, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM batch GROUP BY {KEY}""",
    "numbered": f"""SELECT *, row_number() OVER (ORDER BY b, CAST(first_seen AS DATE), md5(concat_ws(chr(31), {KEY})), {KEY}) AS id
  FROM keyed""",
    "newest": f"""SELECT {KEY}, {DISPLAYED} FROM batch
  QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seen_at DESC, tgid DESC) = 1""",
}


@check(oracle(f"""SELECT CAST(k.id AS BIGINT) AS id, {', '.join('k.' + c for c in NATURAL_KEY)}, n.comm, n.raw_cmdline, n.username,
  {ms('k.first_seen', 'first_ms')}, {ms('k.last_seen', 'last_ms')}
  FROM numbered k JOIN newest n ON {' AND '.join(f'k.{c} = n.{c}' for c in NATURAL_KEY)}""", "live", **UPSERT))
def identity_upsert(spark, sf):
    stage = stage_in(spark, "upsert")
    seen = snapshot_sightings(stage(records(spark, sf), "records"))
    second = F.col("seen_at") >= calendar.at(fx.SECOND_BATCH)
    renamed = seen.where(second).withColumn(
        "username", F.when(F.col("uid") % 7 == 0, F.lit(None)).otherwise(F.col("username"))
    )
    first = stage(ids.identity_upsert(seen.where(~second), fx.empty_identities(spark), stage), "first")
    after = ids.identity_upsert(renamed, first, stage)
    return after.select(
        "id", *NATURAL_KEY, *DISPLAY, as_ms("first_seen", "first_ms"), as_ms("last_seen", "last_ms")
    )


@check(oracle(f"SELECT CAST({NUMBERED} AS BIGINT) AS id, {KEY} FROM keyed", "live",
              keyed=f"SELECT {KEY}, min(seen_at) AS first_seen FROM live GROUP BY {KEY}"))
def surrogate_id(spark, sf):
    fresh = stage_in(spark, "numbering")(ids.identity_fold(snapshot_sightings(records(spark, sf))), "fresh")
    return ids.surrogate_id(fresh, F.lit(0)).select("id", *NATURAL_KEY)


def attributed(spark, sf, window=None):
    """(minute facts, identities) of the samples in a window of whole minutes."""
    f = feeds(spark, sf)
    samples = f.samples if window is None else f.samples.where(
        (F.col("ts") >= calendar.at(window[0])) & (F.col("ts") < calendar.at(window[1]))
    )
    stage = stage_in(spark, "attributed")
    folds = lifetime_folds(replace(f, samples=samples), stage)
    seen = stage(sightings(folds, f), "sightings")
    dimension = stage(ids.identity_delta(seen, fx.empty_identities(spark), stage), "dimension")
    return minute_facts(folds, seen, dimension), dimension


@check(oracle(f"""SELECT {ms("date_trunc('minute', ts)", 'bucket_ms')}, {KEY}, scope, {PAIR} FROM attributed GROUP BY ALL""",
              "attributed"))
def attributed_minutes(spark, sf):
    facts, dimension = attributed(spark, sf)
    named = facts.join(dimension.select(F.col("id").alias("identity_id"), *NATURAL_KEY), "identity_id")
    return named.select(as_ms("bucket", "bucket_ms"), *NATURAL_KEY, "scope", "ingress_bytes", "egress_bytes")


@check(oracle(f"""SELECT host, exe AS group_key, exe AS label, {PAIR} FROM attributed
  WHERE scope = 'external' AND ts >= TIMESTAMP '2024-01-24 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00'
  GROUP BY host, exe ORDER BY ingress_bytes + egress_bytes DESC, host, group_key LIMIT 10""", "attributed"))
def top_exe_of_week(spark, sf):
    """From raw samples to the ten biggest programs of one week."""
    facts, dimension = attributed(spark, sf, (fx.SAMPLES_NOW.replace(day=24), fx.SAMPLES_NOW))
    return verbs.top(facts, dimension, by="exe", limit=10)
