"""Attribution: which durable identity a process belongs to.

All steps run per process or per directory, never per sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bytewake.config import (
    CAPTURE_TOLERANCE, DISPLAY, NATURAL_KEY, NO_PROJECT, PROCESS, PROJECT_MARKERS, UNKNOWN_UID, UNRESOLVED,
)
from bytewake.functions import process
from bytewake.functions.calendar import MICROSECOND, minute_start, utc_date
from bytewake.staging import Stage, as_is

RECORD = NATURAL_KEY + DISPLAY
# Ways in which the lookups below a shallow directory are spread.
SHALLOW_DEPTH = 3
SHALLOW_SPREAD = 32
# New identities of one day are numbered in this many independent groups.
NUMBERING_HEX_DIGITS = 3


# -- cleaning and lookups ---------------------------------------------------

def proc_fields(snapshots: DataFrame) -> DataFrame:
    """Clean fields of each snapshot.  An unreadable field stays NULL."""
    c = F.col
    return snapshots.select(
        *PROCESS,
        "seen_at",
        process.clean_exe(c("exe")).alias("exe"),
        "cwd",
        process.clean_comm(c("comm")).alias("comm"),
        process.join_arguments(c("cmdline")).alias("raw_cmdline"),
        process.real_uid(c("status")).alias("uid"),
        process.cgroup_path(c("cgroup")).alias("unit_or_cgroup"),
    )


def _spread(path: Column, key: Column) -> Column:
    depth = F.size(F.split(path, "/"))
    return F.when(depth <= SHALLOW_DEPTH, F.pmod(F.xxhash64(key), F.lit(SHALLOW_SPREAD))).otherwise(0)


def project_root(directories: DataFrame, markers: DataFrame) -> DataFrame:
    """Deepest marked directory at or above each working directory.

    The walk up the tree is an equi-join of all ancestors with the marked
    directories.  Many working directories share the shallow ancestors
    (``/home``, ``/``), so lookups of those are spread over several keys and
    the few shallow marked directories are repeated for each of them.
    """
    wanted = directories.where(F.col("cwd").isNotNull()).select("host", "cwd").distinct()
    steps = wanted.select("host", "cwd", F.explode(process.ancestors(F.col("cwd"))).alias("dir"))
    steps = steps.withColumn("part", _spread(F.col("dir"), F.col("cwd")).cast("int"))

    last_part = F.when(F.size(F.split("dir", "/")) <= SHALLOW_DEPTH, SHALLOW_SPREAD - 1).otherwise(0)
    marked = (
        markers.where(F.col("marker").isin(*PROJECT_MARKERS))
        .select("host", "dir")
        .distinct()
        .withColumn("part", F.explode(F.sequence(F.lit(0), last_part)))
    )
    # every candidate is a prefix of cwd, so the longest length names the deepest
    deepest = steps.join(marked, ["host", "dir", "part"]).groupBy("host", "cwd").agg(
        F.max(F.length("dir")).alias("length")
    )
    return deepest.select("host", "cwd", F.substring("cwd", F.lit(1), F.col("length")).alias("project_root"))


def with_project_root(rows: DataFrame, markers: DataFrame) -> DataFrame:
    found = project_root(rows, markers)
    return rows.join(found, ["host", "cwd"], "left").withColumn(
        "project_root", F.coalesce("project_root", F.lit(NO_PROJECT))
    )


def usernames(passwd: DataFrame) -> DataFrame:
    """Login name per user number: the first well-formed line wins."""
    valid = passwd.where(F.col("uid").isNotNull() & F.col("username").isNotNull())
    return valid.groupBy("host", "uid").agg(F.min_by("username", "line_no").alias("username"))


def with_username(rows: DataFrame, passwd: DataFrame) -> DataFrame:
    # No broadcast hint: the table grows with the number of hosts.
    return rows.join(usernames(passwd), ["host", "uid"], "left")


# -- identity records -------------------------------------------------------

def snapshot_records(snapshots: DataFrame, passwd: DataFrame, markers: DataFrame) -> DataFrame:
    """One identity record per usable snapshot; unusable ones are left out."""
    clean = proc_fields(snapshots).dropna(
        subset=["exe", "cwd", "comm", "raw_cmdline", "uid", "unit_or_cgroup"]
    )
    named = with_username(with_project_root(clean, markers), passwd)
    return named.withColumn(
        "normalized_cmdline", process.normalize_cmdline(F.col("raw_cmdline"))
    ).select("tgid", "seen_at", *RECORD)


def captures(meta: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Metadata with ``gen_start``, the lifetime that each capture belongs to.

    A capture lands whenever a process number is seen for the first time since
    its last owner went, so it opens a lifetime, unless a snapshot within
    CAPTURE_TOLERANCE opened the same one.  A capture without a time is unusable.
    """
    taken = snapshots.select(*PROCESS, F.col("seen_at").alias("at"), F.col("seen_at").alias("snap"))
    timed = meta.where(F.col("captured_at").isNotNull()).withColumn("at", F.col("captured_at"))
    whole = Window.partitionBy(*PROCESS).orderBy("at")
    before = F.max("snap").over(whole.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min("snap").over(whole.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = lambda a, b: F.unix_micros(b) - F.unix_micros(a) <= CAPTURE_TOLERANCE // MICROSECOND
    placed = timed.unionByName(taken, allowMissingColumns=True).withColumn("before", before).withColumn("after", after)
    return placed.where(F.col("captured_at").isNotNull()).withColumn(
        "gen_start",
        F.when(near(F.col("before"), F.col("at")), F.col("before"))
        .when(near(F.col("at"), F.col("after")), F.col("after")).otherwise(F.col("at")),
    ).drop("at", "snap", "before", "after")


def meta_records(meta: DataFrame, passwd: DataFrame) -> DataFrame:
    """Degraded records from the metadata that outlives the process.

    Metadata with an unknown field is unusable, as a snapshot is.
    """
    comm = process.cut_at_nul(F.col("comm"))
    lifetime = [c for c in ("gen_start",) if c in meta.columns]
    degraded = meta.dropna(subset=["uid", "cgroup_id", "comm"]).select(
        *PROCESS,
        *lifetime,
        "uid",
        F.concat(F.lit("cgroup-id:"), F.col("cgroup_id")).alias("unit_or_cgroup"),
        F.lit(UNRESOLVED).alias("exe"),
        F.lit(UNRESOLVED).alias("project_root"),
        F.concat(F.lit("<unresolved:"), comm, F.lit(">")).alias("normalized_cmdline"),
        comm.alias("comm"),
        F.lit("").alias("raw_cmdline"),
    )
    return with_username(degraded, passwd).select("tgid", *lifetime, *RECORD)


def fully_unresolved(host: Column) -> Column:
    """The record of last resort: owner unknown, never taken for root."""
    unresolved = F.lit(UNRESOLVED)
    return F.struct(
        host.alias("host"),
        F.lit(UNKNOWN_UID).cast("long").alias("uid"),
        unresolved.alias("unit_or_cgroup"),
        unresolved.alias("exe"),
        unresolved.alias("project_root"),
        unresolved.alias("normalized_cmdline"),
        F.lit("").alias("comm"),
        F.lit("").alias("raw_cmdline"),
        F.lit(None).cast("string").alias("username"),
    )


def _one_each(records: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Records packed as one column, one per key: two would count bytes twice."""
    return records.groupBy(*keys).agg(F.min(F.struct(*RECORD)).alias(name))


def resolve_chain(processes: DataFrame, snapshots: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach an identity record to every process, whole record by whole record.

    ``processes`` has (host, tgid, gen_start), ``snapshots`` comes from
    ``snapshot_records`` and ``meta`` from ``meta_records``.  The first source
    that knows this lifetime of the process wins; nothing is dropped.
    """
    of_meta = [*PROCESS, "gen_start"] if "gen_start" in meta.columns else list(PROCESS)
    starts = snapshots.withColumnRenamed("seen_at", "gen_start")
    by_start = _one_each(starts, [*PROCESS, "gen_start"], "live")
    by_process = _one_each(meta, of_meta, "fallback")
    return (
        processes.join(by_start, [*PROCESS, "gen_start"], "left")
        .join(by_process, of_meta, "left")
        .withColumn("record", F.coalesce("live", "fallback", fully_unresolved(F.col("host"))))
        .withColumn(
            "source",
            F.when(F.col("live").isNotNull(), "snapshot")
            .when(F.col("fallback").isNotNull(), "metadata")
            .otherwise("none"),
        )
        .drop("live", "fallback")
    )


# -- process lifetimes ------------------------------------------------------

def lifetime_starts(snapshots: DataFrame, captured: DataFrame | None = None) -> DataFrame:
    """When process numbers changed hands: at snapshots and at captures (see ``captures``)."""
    starts = snapshots.select(*PROCESS, F.col("seen_at").alias("gen_start"))
    if captured is not None:
        starts = starts.unionByName(captured.select(*PROCESS, "gen_start"))
    return starts.distinct()


def contested_minutes(starts: DataFrame) -> DataFrame:
    """(process, minute) in which a process number changes hands, from the starts alone.

    The first start of a number also covers what precedes it, and one that
    falls on the minute's beginning leaves the minute whole.
    """
    begun = minute_start(F.col("gen_start"))
    first = F.min("gen_start").over(Window.partitionBy(*PROCESS))
    later = starts.withColumn("first", first).where((F.col("gen_start") > F.col("first")) & (F.col("gen_start") > begun))
    return later.select(*PROCESS, begun.alias("bucket")).distinct()


def _slice(ts: Column, seconds: int) -> Column:
    whole = F.unix_seconds(ts)
    return whole - F.pmod(whole, F.lit(seconds))


def tgid_lifetime(rows: DataFrame, starts: DataFrame, ts: str, slice_seconds: int = 3600) -> DataFrame:
    """Add ``gen_start``: when the process that ``tgid`` named at ``ts`` began.

    The latest start at or before ``ts`` counts.  What precedes the first
    start belongs to it as well, because a snapshot is taken after the first
    transfer.  NULL means that no snapshot of the process exists.

    Rows and starts are merged by sorting inside time slices of one process,
    so no row meets more than its own slice; the latest start of earlier
    slices is carried forward over one summary row per slice.
    """
    keys = [*PROCESS, "slice"]
    sliced = rows.withColumn("slice", _slice(F.col(ts), slice_seconds))
    begun = starts.withColumn("slice", _slice(F.col("gen_start"), slice_seconds))

    per_slice = (
        sliced.select(*keys, F.lit(None).cast("timestamp").alias("gen_start"))
        .unionByName(begun)
        .groupBy(*keys)
        .agg(F.min("gen_start").alias("head"), F.max("gen_start").alias("tail"))
    )
    whole = Window.partitionBy(*PROCESS)
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(
        *keys, F.coalesce(F.max("tail").over(before), F.min("head").over(whole)).alias("carry")
    )

    events = sliced.withColumn("start", F.lit(None).cast("timestamp")).withColumn("at", F.col(ts))
    marks = begun.select(*keys, F.col("gen_start").alias("start"), F.col("gen_start").alias("at"))
    # equal instants share a frame, so a start covers the rows of its own instant
    inside = Window.partitionBy(*keys).orderBy("at")
    merged = events.unionByName(marks, allowMissingColumns=True).withColumn(
        "latest", F.max("start").over(inside)
    )
    return (
        merged.where(F.col("start").isNull())
        .join(carried, keys, "left")
        .withColumn("gen_start", F.coalesce("latest", "carry"))
        .drop("start", "at", "latest", "carry", "slice")
    )


def minute_lifetime(folds: DataFrame, starts: DataFrame) -> DataFrame:
    """Add ``gen_start`` to minute folds, and ``torn`` where it cannot be told.

    Starts shrink to the first and last of each minute before the shuffle.
    With at most two folds per minute a process then brings three rows per
    minute of the period at hand, however many samples or starts it has.  A
    minute is torn when another process may have taken over the number between
    its first and its last sample.
    """
    minute = F.unix_seconds("bucket").alias("minute")
    marks = starts.groupBy(*PROCESS, minute_start(F.col("gen_start")).alias("bucket")).agg(
        F.min("gen_start").alias("head"), F.max("gen_start").alias("tail")
    )
    rows = folds.unionByName(marks, allowMissingColumns=True).withColumn("minute", minute)
    whole = Window.partitionBy(*PROCESS)
    earlier = whole.orderBy("minute").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(*PROCESS, "minute")
    placed = (
        rows.withColumn("before", F.max("tail").over(earlier))
        .withColumn("first", F.min("head").over(whole))
        .withColumn("head", F.min("head").over(here))
        .withColumn("tail", F.max("tail").over(here))
        .where(F.col("min_ts").isNotNull())
    )
    settled = F.coalesce(F.col("tail") <= F.col("min_ts"), F.lit(False))
    later = F.coalesce(F.col("head") > F.col("max_ts"), F.lit(True))
    only_first = F.coalesce(F.col("tail") == F.col("first"), F.lit(False))
    return (
        placed.withColumn(
            "gen_start", F.when(settled, F.col("tail")).otherwise(F.coalesce("before", "first"))
        )
        .withColumn("torn", ~(settled | later | only_first))
        .drop("minute", "before", "first", "head", "tail")
    )


# -- dimension --------------------------------------------------------------

def identity_fold(sightings: DataFrame) -> DataFrame:
    """One row per natural key: earliest and latest sighting, newest display.

    ``sightings`` carries the record plus (first_seen, last_seen, seq); ``seq``
    orders sightings of one instant.  The display attributes travel as one
    struct, so a newer NULL user name replaces an older one.
    """
    newest = F.max_by(F.struct(*DISPLAY), F.struct("last_seen", "seq"))
    return (
        sightings.groupBy(*NATURAL_KEY)
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.max_by("seq", F.struct("last_seen", "seq")).alias("seq"),
            newest.alias("display"),
        )
        .select(*NATURAL_KEY, "display.*", "first_seen", "last_seen", "seq")
    )


def surrogate_id(fresh: DataFrame, after: Column) -> DataFrame:
    """Number new keys upwards from ``after``, by day of first sight.

    Within a day the order is that of a digest of the key.  Counting happens
    per (day, digest prefix), so no task sorts all keys; two small windows turn
    the counts into offsets.
    """
    digest = F.md5(F.concat_ws("\x1f", *NATURAL_KEY))
    placed = (
        fresh.withColumn("day", utc_date(F.col("first_seen")))
        .withColumn("digest", digest)
        .withColumn("prefix", F.substring("digest", 1, NUMBERING_HEX_DIGITS))
    )
    counts = placed.groupBy("day", "prefix").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    in_day = counts.withColumn(
        "inner", F.coalesce(F.sum("n").over(earlier.partitionBy("day").orderBy("prefix")), F.lit(0))
    )
    # one row per day: bounded by the calendar, not by the data
    days = counts.groupBy("day").agg(F.sum("n").alias("n"))
    days = days.select(
        "day",
        F.coalesce(
            F.sum("n").over(earlier.partitionBy(F.lit(0)).orderBy("day")), F.lit(0)
        ).alias("outer"),
    )
    offsets = in_day.join(days, "day").select("day", "prefix", (F.col("inner") + F.col("outer")).alias("skip"))
    in_group = Window.partitionBy("day", "prefix").orderBy("digest", *NATURAL_KEY)
    return (
        placed.withColumn("rank", F.row_number().over(in_group))
        .join(offsets, ["day", "prefix"])
        .withColumn("id", (after + F.col("skip") + F.col("rank")).cast("long"))
        .drop("day", "digest", "prefix", "rank", "skip")
    )


def identity_delta(
    sightings: DataFrame, dimension: DataFrame | Callable[[DataFrame], DataFrame], stage: Stage = as_is, top: int | None = None,
) -> DataFrame:
    """Rows of the dimension that ``sightings`` refer to, as they are afterwards.

    ``changed`` tells which of them are new or differ from what was known; only
    those need to be written.  Known keys keep id and first_seen; new keys get ids above the highest one.
    ``dimension`` may hold several rows per identity (base and deltas, told
    apart by ``version``), or be a function that finds rows for some keys; then
    ``top``, the highest id given, must be known.  Only rows of the keys at hand are merged: a small
    batch filters the dimension where it lies instead of shuffling it.
    """
    key = list(NATURAL_KEY)
    news = stage(identity_fold(sightings), "news")
    if callable(dimension):
        dimension = dimension(news.select(*key))
    if "version" not in dimension.columns:
        dimension = dimension.withColumn("version", F.lit(0))
    known = identity_merge(dimension.join(news.select(*key), key, "left_semi")).select(
        "id", *key, *[F.col(c).alias(f"old_{c}") for c in (*DISPLAY, "first_seen", "last_seen")]
    )
    matched = stage(news.join(known, key, "left"), "matched")
    newer = F.col("last_seen") >= F.col("old_last_seen")
    touched = matched.where(F.col("id").isNotNull()).select(
        "id",
        *key,
        *[F.when(newer, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in DISPLAY],
        F.least("first_seen", "old_first_seen").alias("first_seen"),
        F.greatest("last_seen", "old_last_seen").alias("last_seen"),
        (
            (F.col("first_seen") < F.col("old_first_seen")) | (F.col("last_seen") > F.col("old_last_seen"))
            | (newer & ~F.struct(*DISPLAY).eqNullSafe(F.struct(*[F.col(f"old_{c}").alias(c) for c in DISPLAY])))
        ).alias("changed"),
    )
    fresh = matched.where(F.col("id").isNull()).select(*key, *DISPLAY, "first_seen", "last_seen")
    after = F.lit(top) if top is not None else dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).scalar()
    numbered = surrogate_id(fresh, after).withColumn("changed", F.lit(True))
    return touched.unionByName(numbered.select(*touched.columns))


def identity_merge(rows: DataFrame) -> DataFrame:
    """Newest state per identity out of base and delta rows."""
    newest = F.max_by(F.struct(*DISPLAY), F.struct("last_seen", "version"))
    return (
        rows.groupBy("id", *NATURAL_KEY)
        .agg(
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            newest.alias("display"),
        )
        .select("id", *NATURAL_KEY, "display.*", "first_seen", "last_seen")
    )


def identity_upsert(sightings: DataFrame, dimension: DataFrame, stage: Stage = as_is) -> DataFrame:
    """The dimension after ``sightings``: the touched rows replace the old ones."""
    delta = identity_delta(sightings, dimension, stage).where("changed").drop("changed")
    version = F.lit(1)
    return identity_merge(
        dimension.withColumn("version", F.lit(0)).unionByName(delta.withColumn("version", version))
    )
