"""Late samples: compare what landed with what was counted, add the difference."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewake.config import TIER_KEY, Settings
from bytewake.functions import calendar
from bytewake.plans.attribution import Feeds, attribute, lifetime_folds
from bytewake.sources.store import IDENTITY_TABLE, Store
from bytewake.staging import staging

BYTES = ("ingress_bytes", "egress_bytes")


def late_samples(recomputed: DataFrame, counted: DataFrame) -> DataFrame:
    """Correction deltas that turn ``counted`` into ``recomputed``.

    A difference may be negative: bytes that were counted for the wrong
    process lifetime move to the right one.
    """
    left = recomputed.select(*TIER_KEY, *[F.col(c).alias(f"want_{c}") for c in BYTES])
    right = counted.select(*TIER_KEY, *[F.col(c).alias(f"have_{c}") for c in BYTES])
    zero = F.lit(0)
    both = left.join(right, list(TIER_KEY), "full_outer").select(
        *TIER_KEY,
        *[(F.coalesce(f"want_{c}", zero) - F.coalesce(f"have_{c}", zero)).alias(c) for c in BYTES],
    )
    return both.where((F.col("ingress_bytes") != 0) | (F.col("egress_bytes") != 0))


def reconcile(
    spark: SparkSession, store: Store, feeds: Feeds, batch_id: str,
    from_ts: datetime, through: datetime, settings: Settings,
) -> None:
    """Correct the minutes of [from_ts, through) and every tier built on them.

    Minutes already pruned are left alone: a pruned minute would look missing.
    Corrections below a tier's watermark are rolled up with them; those above
    it are picked up by the ordinary rollup.
    """
    if store.committed(batch_id):
        raise ValueError(f"batch {batch_id!r} was committed before")
    pruned = store.pruned_through("minute")
    if pruned is not None and pruned > from_ts:
        # a minute cut by the bound is gone in full
        from_ts = calendar.floor_moment(pruned - calendar.MICROSECOND, "minute", settings.tz) + calendar.MINUTE
    landed = feeds.samples.where(
        (F.col("ts") >= calendar.at(from_ts)) & (F.col("ts") < calendar.at(through))
    )
    with staging(spark, "reconcile") as stage:
        folds = lifetime_folds(replace(feeds, samples=landed), stage)
        facts = attribute(store, folds, feeds, batch_id, stage)
        counted = store.scan("minute", from_ts, through)
        batches = store.stage_minutes(late_samples(facts, counted), batch_id, settings, stage)
    store.commit_batches([(IDENTITY_TABLE, batch_id), *batches])
