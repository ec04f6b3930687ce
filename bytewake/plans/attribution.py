"""Samples in, identities and minute facts out."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewake.config import NATURAL_KEY, PROCESS, Settings
from bytewake.functions import calendar
from bytewake.operators import identity as ids
from bytewake.operators import samples as smp
from bytewake.operators.tiers import byte_sums
from bytewake.sources.store import IDENTITY_TABLE, Store
from bytewake.staging import Stage, staging

LIFETIME = [*PROCESS, "gen_start"]
PLACED = (*LIFETIME, "bucket", "scope", "ingress_bytes", "egress_bytes", "min_ts", "max_ts")


@dataclass(frozen=True)
class Feeds:
    """The landed inputs of one attribution run."""

    samples: DataFrame
    snapshots: DataFrame
    meta: DataFrame
    passwd: DataFrame
    markers: DataFrame

    def captures(self) -> DataFrame:
        return ids.captures(self.meta, self.snapshots)

    def starts(self) -> DataFrame:
        return ids.lifetime_starts(self.snapshots, self.captures())


def narrowed(feeds: Feeds, folds: DataFrame, stage: Stage) -> Feeds:
    """Lookup feeds of the processes at hand; cleaning then skips all others.

    They are staged, because a filter on cleaned fields would move below the
    join and clean every snapshot there is, each time one of the feeds is used.
    """
    processes = stage(folds.select(*PROCESS).distinct(), "processes")
    return replace(
        feeds,
        snapshots=stage(feeds.snapshots.join(processes, list(PROCESS), "left_semi"), "snapshots"),
        meta=stage(feeds.meta.join(processes, list(PROCESS), "left_semi"), "meta"),
    )


def lifetime_folds(feeds: Feeds, stage: Stage) -> DataFrame:
    """Minute counters per process lifetime, exact to the microsecond.

    Samples are folded by minute and the folds, not the samples, are assigned
    to lifetimes.  Minutes in which a process number changes hands are known
    from the starts before any sample is read; the same scan folds those by
    instant, to be assigned one by one.
    """
    samples, starts = feeds.samples, stage(feeds.starts(), "starts")
    contested = stage(ids.contested_minutes(starts), "contested")
    if contested.isEmpty():
        return stage(ids.minute_lifetime(smp.minute_fold(samples), starts), "placed").select(*PLACED)
    return placed(stage(smp.split_fold(samples, contested), "folds"), starts, contested, stage)


def placed(folds: DataFrame, starts: DataFrame, contested: DataFrame, stage: Stage) -> DataFrame:
    """Minute counters per process lifetime, from folds that have an ``instant`` where the minute is contested."""
    whole = ids.minute_lifetime(folds.where(F.col("instant").isNull()).drop("instant"), starts)
    # one row per instant, so a slice of one second has a fixed upper size
    instants = folds.where(F.col("instant").isNotNull())
    reused = starts.join(contested.select(*PROCESS).distinct(), list(PROCESS), "left_semi")
    exact = ids.tgid_lifetime(instants, reused, "instant", slice_seconds=1)
    pieces = exact.groupBy(*LIFETIME, "bucket", "scope").agg(
        *byte_sums(), F.min("min_ts").alias("min_ts"), F.max("max_ts").alias("max_ts")
    )
    return stage(whole.select(*PLACED).unionByName(pieces.select(*PLACED)), "placed")


def sightings(folds: DataFrame, feeds: Feeds) -> DataFrame:
    """One row per process lifetime with traffic, and the record it resolves to."""
    lifetimes = folds.groupBy(*LIFETIME).agg(F.min("min_ts").alias("first_ts"))
    resolved = ids.resolve_chain(
        lifetimes,
        ids.snapshot_records(feeds.snapshots, feeds.passwd, feeds.markers),
        ids.meta_records(feeds.captures(), feeds.passwd),
    )
    seen = F.coalesce("gen_start", "first_ts")
    return resolved.select(
        *LIFETIME,
        "source",
        *[f"record.{c}" for c in ids.RECORD if c not in PROCESS],
        seen.alias("first_seen"),
        seen.alias("last_seen"),
        F.col("tgid").alias("seq"),
    )


def minute_facts(folds: DataFrame, seen: DataFrame, dimension: DataFrame) -> DataFrame:
    """Minute rows keyed by identity id.

    The lookup runs once per lifetime; folds then join three narrow columns.
    """
    numbered = seen.select(*LIFETIME, *NATURAL_KEY[1:]).join(
        dimension.select(F.col("id").alias("identity_id"), *NATURAL_KEY), list(NATURAL_KEY)
    )
    lookup = numbered.select(
        F.col("host").alias("h"), F.col("tgid").alias("t"), F.col("gen_start").alias("g"), "identity_id"
    )
    same = (
        (F.col("host") == F.col("h"))
        & (F.col("tgid") == F.col("t"))
        & F.col("gen_start").eqNullSafe(F.col("g"))
    )
    return folds.join(lookup, same).groupBy("bucket", "identity_id", "scope").agg(*byte_sums())


def ingest(
    spark: SparkSession, store: Store, feeds: Feeds, batch_id: str, settings: Settings,
    window: tuple[datetime, datetime] | None = None,
) -> None:
    """Attribute one batch of samples and commit it.

    With a ``window`` only samples of [from, to) are taken from the feed, and a
    window that overlaps one taken before is refused, so that a landing folder
    can be read again and again.  Without one the feed must hold new samples
    only.  A batch that was committed before is left alone, and refused if it
    comes with another window than then; of one that failed half way nothing is
    used.
    """
    if store.committed(batch_id):
        taken = store.window_read(batch_id)
        if window != taken and (window is None or taken is None or tuple(map(calendar.micros, window)) != tuple(map(calendar.micros, taken))):
            raise ValueError(f"batch {batch_id!r} was committed with samples of {taken or 'no window'}, not of {window}")
        return
    if window is not None:
        taken = store.overlapping(window)
        if taken is not None:
            raise ValueError(f"samples of this window are part of batch {taken!r}")
        inside = (F.col("ts") >= calendar.at(window[0])) & (F.col("ts") < calendar.at(window[1]))
        feeds = replace(feeds, samples=feeds.samples.where(inside))
    with staging(spark, "ingest") as stage:
        folds = lifetime_folds(feeds, stage)
        facts = attribute(store, folds, feeds, batch_id, stage)
        batches = store.stage_minutes(facts, batch_id, settings, stage)
    store.commit_batches([(IDENTITY_TABLE, batch_id), *batches], read=window)


def attribute(store: Store, folds: DataFrame, feeds: Feeds, batch_id: str, stage: Stage) -> DataFrame:
    """Minute facts of folds; the identities they need are staged with them."""
    seen = stage(sightings(folds, narrowed(feeds, folds, stage)), "sightings")
    delta = stage(ids.identity_delta(seen, store.identity_rows, stage, store.highest_id()), "delta")
    store.stage_identities(delta.where("changed"), batch_id)
    # every key of this batch is in its own delta, so the old dimension is not read again
    facts = stage(minute_facts(folds, seen, delta), "facts")
    before, after = (rows.agg(*byte_sums()).first() for rows in (folds, facts))
    if before != after:
        raise RuntimeError(f"batch {batch_id!r} holds {before} but {after} were attributed")
    return facts
