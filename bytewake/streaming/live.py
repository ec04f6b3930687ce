"""Continuous counting, first sightings and the live ranking."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from bytewake import schemas, session
from bytewake.config import PROCESS, TIER_KEY, Settings
from bytewake.functions import calendar
from bytewake.operators import identity as ids
from bytewake.operators import samples as smp
from bytewake.operators import verbs
from bytewake.operators.tiers import minute_merge
from bytewake.plans import attribution
from bytewake.plans.attribution import Feeds
from bytewake.sources.store import IDENTITY_TABLE, Store
from bytewake.staging import Stage, staging


BYTES = ("ingress_bytes", "egress_bytes")
#: how finely a stream tells processes apart that had the same number within one minute
SLICE = timedelta(seconds=1)


def _interval(delay: timedelta) -> str:
    return f"{int(delay.total_seconds() * 1000)} milliseconds"


def stream_minute_fold(samples: DataFrame, delay: timedelta) -> DataFrame:
    """Tumbling one-minute counters; a minute appears once the watermark closes it.

    Only sums and a span are kept per (minute, process, scope), so the state is
    as wide as the processes that moved bytes within the delay.
    """
    return _minutes(samples, delay)


def stream_slice_fold(samples: DataFrame, delay: timedelta, slices: timedelta) -> DataFrame:
    """``stream_minute_fold`` with one row per slice of time in which a process moved bytes.

    The slices of a minute appear together, once the watermark closes the
    minute.  The state has at most (minute / slice) times the rows, and no more
    than there are samples.
    """
    instant, wide = F.unix_micros("ts"), F.lit(slices // timedelta(microseconds=1))
    return _minutes(samples, delay, F.timestamp_micros(instant - F.pmod(instant, wide)).alias("slice"))


def _minutes(samples: DataFrame, delay: timedelta, *more: Column) -> DataFrame:
    folded = (
        smp.transfers(samples)
        .withWatermark("ts", _interval(delay))
        .groupBy(F.window("ts", "1 minute").alias("minute"), *PROCESS, "scope", *more)
        .agg(
            *smp.direction_sums(F.col("dir"), F.col("bytes")),
            F.min("ts").alias("min_ts"),
            F.max("ts").alias("max_ts"),
        )
    )
    return folded.select(
        *PROCESS, F.col("minute.start").alias("bucket"), "scope",
        "ingress_bytes", "egress_bytes", "min_ts", "max_ts",
    )


def stream_first_sight(samples: DataFrame, delay: timedelta) -> DataFrame:
    """Processes that have not been seen for a while: candidates for a lookup.

    A process that comes back once the watermark has left it behind is announced
    again; resolving it twice yields the same identity.
    """
    return (
        smp.transfers(samples)
        .select(*PROCESS, "ts")
        .withWatermark("ts", _interval(delay))
        .dropDuplicatesWithinWatermark(list(PROCESS))
    )


def batch_name(stream: str, number: int) -> str:
    return f"{stream}-{number:012d}"


def ingest_stream(
    store: Store, samples: DataFrame, load: Callable[[], Feeds], delay: timedelta, stream: str,
    settings: Settings, slices: timedelta = SLICE,
) -> DataStreamWriter:
    """Count a sample stream into the store.

    A minute in which a process number changes hands is split between its
    processes.  Which minutes those are is known when a minute closes, from the
    starts that ``load`` knows by then, so until that the stream keeps counters
    by slice.  A slice goes to the process that had the number at its first
    sample; all other minutes are whole again before anything is looked up.

    ``load`` returns the lookup feeds as of now; their samples are not used.
    The run (the identity that a checkpoint keeps) and the micro-batch number
    name the batch, so a replayed one counts once.  A run with a new checkpoint
    reads old samples again, in batches of its own: of each counter that an
    earlier run of this stream wrote, only the difference is added.  Every
    minute up to the last one written is complete, which is recorded for the
    rollup.
    """

    def write(folds: DataFrame, number: int) -> None:
        run = run_id(folds)
        name = batch_name(f"{stream}-{run}", number)
        with staging(store.spark, "micro-batch") as stage:
            # read in full even when there is nothing to do: that moves the state on
            parts = stage(folds, "parts")
            last = parts.agg(F.unix_micros(F.max("bucket")).alias("us")).first().us
            if last is None or store.committed(name):
                return
            feeds = attribution.narrowed(load(), parts, stage)
            starts = stage(feeds.starts(), "starts")
            here = parts.select(*PROCESS, "bucket").distinct()
            contested = stage(ids.contested_minutes(starts).join(here, [*PROCESS, "bucket"], "left_semi"), "contested")
            placed = attribution.placed(stage(smp.split_parts(parts, contested), "folds"), starts, contested, stage)
            facts = attribution.attribute(store, placed, feeds, name, stage)
            counted = store.batches_of("minute", stream, run, facts)
            if counted is not None:
                facts = less(facts, counted)
            batches = store.stage_minutes(facts, name, settings, stage)
        through = calendar.EPOCH + timedelta(microseconds=last) + calendar.MINUTE
        store.commit_batches([(IDENTITY_TABLE, name), *batches], minutes_through=through)

    return (
        stream_slice_fold(samples, delay, slices)
        .writeStream.outputMode("append")
        .queryName(stream)
        .foreachBatch(write)
    )


def run_id(folds: DataFrame) -> str:
    """Of the streaming query that a micro-batch belongs to; a checkpoint keeps it over restarts."""
    return (folds.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "run").replace("-", "")[:12]


def less(facts: DataFrame, counted: DataFrame) -> DataFrame:
    """What is missing of each counter; counters that ``facts`` does not have stay as they are."""
    have = minute_merge(counted).select(*TIER_KEY, *[F.col(c).alias(f"have_{c}") for c in BYTES])
    rest = facts.join(have, list(TIER_KEY), "left").select(
        *TIER_KEY, *[(F.col(c) - F.coalesce(f"have_{c}", F.lit(0))).alias(c) for c in BYTES])
    return rest.where((F.col(BYTES[0]) != 0) | (F.col(BYTES[1]) != 0))


def idempotent_commit(store: Store, tier: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for fact rows: every counter counts once.

    A replayed micro-batch is known by its run and number.  A run with a new
    checkpoint may cut the stream elsewhere, so of its counters only what
    earlier runs did not write is added.
    """

    def write(facts: DataFrame, number: int) -> None:
        run = run_id(facts)
        name = batch_name(f"{stream}-{run}", number)
        with staging(store.spark, "commit") as stage:
            rows = stage(minute_merge(facts), "rows")
            if store.committed(name):
                return
            counted = store.batches_of(tier, stream, run, rows)
            store.append(tier, rows if counted is None else less(rows, counted), name)

    return write


# Turns minute folds into (facts, identities); may use the stage it is given.
Identify = Callable[[DataFrame, Stage], tuple[DataFrame, DataFrame]]


def stream_watch(
    samples: DataFrame,
    identify: Identify,
    emit: Callable[[DataFrame, int], None],
    delay: timedelta,
    by: str = "identity",
    limit: int | None = 0,
    scope: str | None = None,
    closed: bool = False,
) -> DataStreamWriter:
    """Ranking of the minutes that changed, once per trigger, or with ``closed`` of each minute when it has ended.

    ``emit`` receives the ranked rows.  Only changed counters reach a trigger,
    already summed; those of the same minutes that did not change are kept in a
    table of open minutes, so a ranking is always one of the whole minute.  The
    table is as large as the stream's own state and is written under the name of
    the run and the trigger, next to the one before it.
    """
    # a stream's own session does without adaptive plans, so micro-batches are worked on in the one it came from
    spark = samples.sparkSession

    def rank_closed(folds: DataFrame, number: int) -> None:
        with staging(spark, "watch") as stage:
            facts, identity = identify(stage(folds, "minutes"), stage)
            emit(verbs.top_per_bucket(facts, identity, by, limit, scope), number)

    def rank(folds: DataFrame, number: int) -> None:
        at = lambda n: session.shared_dir(spark, f"watch-{run_id(folds)}/{n:012d}")
        with staging(spark, "watch") as stage:
            changed = stage(folds, "minutes")
            before = read_if_there(spark, at(number - 1), changed.schema)
            kept = before.join(changed, [*PROCESS, "bucket", "scope"], "left_anti").unionByName(changed)
            # what replaces a counter ends no earlier than the counter did
            newest = F.lit(before.select("max_ts").unionByName(changed.select("max_ts")).agg(F.max("max_ts").alias("ts")).scalar())
            still_open = F.col("bucket") + F.expr("INTERVAL 1 MINUTE") > newest - F.expr(f"INTERVAL {_interval(delay)}")
            touched = changed.select("bucket").distinct()
            # a minute is kept in full as long as it can change, and for this trigger
            kept.join(touched.withColumn("now", F.lit(True)), "bucket", "left").where(
                still_open | F.col("now")).drop("now").write.mode("overwrite").parquet(at(number))
            running = spark.read.schema(changed.schema).parquet(at(number)).join(touched, "bucket", "left_semi")
            facts, identity = identify(running, stage)
            emit(verbs.top_per_bucket(facts, identity, by, limit, scope), number)
        session.remove(spark, [at(number - 2)])

    folded = stream_minute_fold(samples, delay).writeStream
    return folded.outputMode("append").foreachBatch(rank_closed) if closed else folded.outputMode("update").foreachBatch(rank)


def read_if_there(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty(spark, schema)


def identify_with(store: Store, load: Callable[[], Feeds]) -> Identify:
    """Attribution for a live view: nothing is written to the store.

    Identities the store does not know yet get the ids that come next, for
    this trigger only.
    """

    def identify(folds: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
        feeds = attribution.narrowed(load(), folds, stage)
        placed = stage(ids.tgid_lifetime(folds, feeds.starts(), "min_ts"), "placed")
        seen = stage(attribution.sightings(placed, feeds), "sightings")
        identity = stage(ids.identity_delta(seen, store.identity_rows, stage, store.highest_id()), "identities")
        return attribution.minute_facts(placed, seen, identity), identity

    return identify
