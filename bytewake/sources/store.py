"""Tier facts and identities at rest.

Parquet cannot update rows, and need not: counters add up.  Every write is a
batch of delta rows in folders of its own,

    <root>/traffic_<tier>/dt=<utc date, of days the month, of months the year>/batch_id=<attempt>/...
    <root>/identity/bucket=<of the key, or -1>/batch_id=<attempt>/...

and readers sum deltas by key.  An attempt is a batch's name and a new suffix
each time it is staged.  A small commit log, appended file by file, says what
counts:

    add     the batch was written to rolled-up bound ``to_ts``; ``n`` is its highest identity id
    lies    the attempt's rows of one date count
    drop    the batch's rows of one date no longer do: replaced or merged
    prune   rows before to_ts no longer count
    read    landed samples of [from_ts, to_ts) went into a batch

A scan takes from the log which dates of its window have rows that count and
opens only those folders, so nothing lists a whole tier.  What never reached
the log is invisible.  One writer per store.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from datetime import date, datetime, timedelta, timezone
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from bytewake import schemas, session
from bytewake.config import ALL_SCOPES, NATURAL_KEY, TIERS, Settings
from bytewake.functions import calendar
from bytewake.operators import identity as ids
from bytewake.operators import tiers, verbs
from bytewake.staging import Stage

IDENTITY_TABLE = "identity"
#: hexadecimal digits that tell attempts of one batch apart
ATTEMPT = 12
#: files of the log from which on upkeep merges folders, removes dead ones and rewrites log and dimension
LOG_FILES = 256
#: folders of a date from which on upkeep merges them
FOLDERS = 16
#: parts of the merged dimension by hash of the natural key; deltas that were not merged yet lie in RECENT
BUCKETS, RECENT = 64, -1
#: tells of a row group whether an identity is in it; as large as the identities in the group need
BLOOM = {"parquet.bloom.filter.enabled#identity_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: stand for no bound
EARLIEST, LATEST = date(1000, 1, 1), date(9000, 1, 1)
#: names of the batches of one stream: its name, its run and a number, or what upkeep has merged them to
STREAM_BATCH = r"^(.*)-([0-9a-z]+)-[0-9a-f]{12}$"

#: A stretch of a tier: its name, and the half-open window
Span = tuple[str, datetime | None, datetime | None]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        calendar.require_utc(spark)
        self.spark = spark
        self.root = root.rstrip("/")
        self._staged: dict[tuple[str, str], tuple[str, list[date]]] = {}

    # -- commit log ---------------------------------------------------------

    def _path(self, table: str) -> str:
        return f"{self.root}/{table if table in (IDENTITY_TABLE, 'commit_log') else f'traffic_{table}'}"

    def log(self) -> DataFrame:
        if not session.exists(self.spark, self._path("commit_log")):
            return schemas.empty(self.spark, schemas.COMMIT)
        return self.spark.read.schema(schemas.COMMIT).parquet(self._path("commit_log"))

    def _commit(self, entries: list[dict]) -> None:
        """Append entries as one file, so that they become visible together."""
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        rows = [{"seq": seq} | {k: _utc(v) if isinstance(v, datetime) else v for k, v in e.items()} for e in entries]
        table = pa.table({f.name: pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in schemas.COMMIT})
        self.spark.createDataFrame(table).coalesce(1).write.mode("append").parquet(self._path("commit_log"))

    def compact_log(self) -> None:
        """Rewrite the log as one file, without what it says of dates that are gone.

        Entries are statements, so one that is found in old and new files does no harm.
        """
        log = self.log()
        old = log.inputFiles()
        if len(old) > 1:
            for (action, tier), bound in self.marks().items():
                if action == "prune":
                    log = log.where((F.col("tier") != tier) | F.col("dt").isNull() | (F.col("dt") >= F.lit(tiers.folder_date(bound.date(), tier))))
            log.distinct().coalesce(1).write.mode("append").parquet(self._path("commit_log"))
            session.remove(self.spark, list(old))

    def marks(self) -> dict[tuple[str, str], datetime]:
        """By (action, tier): how far each tier is rolled up (``add``) and pruned (``prune``), in one read of the log."""
        bounds = self.log().where(F.col("action").isin("add", "prune")).groupBy("action", "tier").agg(
            F.unix_micros(F.max("to_ts")).alias("us"))
        return {(r.action, r.tier): calendar.EPOCH + timedelta(microseconds=r.us) for r in bounds.collect() if r.us is not None}

    def watermark(self, tier: str) -> datetime | None:
        """Exclusive bound of the finer buckets already rolled into ``tier``."""
        return self.marks().get(("add", tier))

    def pruned_through(self, tier: str) -> datetime | None:
        return self.marks().get(("prune", tier))

    def committed(self, batch_id: str) -> bool:
        return not self.log().where((F.col("batch_id") == batch_id) & (F.col("action") == "add")).isEmpty()

    def window_read(self, batch_id: str) -> tuple[datetime, datetime] | None:
        """The stretch of landed samples that a batch holds."""
        row = self.log().where((F.col("action") == "read") & (F.col("batch_id") == batch_id)).select(
            F.unix_micros("from_ts").alias("a"), F.unix_micros("to_ts").alias("b")).first()
        return row and tuple(calendar.EPOCH + timedelta(microseconds=us) for us in row)

    def overlapping(self, window: tuple[datetime, datetime]) -> str | None:
        """A batch that holds landed samples of a part of the window."""
        start, end = window
        row = self.log().where((F.col("action") == "read") & (F.col("from_ts") < calendar.at(end))
                               & (F.col("to_ts") > calendar.at(start))).select("batch_id").first()
        return row[0] if row else None

    # -- writing ------------------------------------------------------------

    def append(self, tier: str, facts: DataFrame, batch_id: str, from_ts: datetime | None = None,
               to_ts: datetime | None = None) -> None:
        """Write a delta batch of facts and make it count, in place of an earlier one of that name."""
        self.stage(tier, facts, batch_id)
        self.commit_batches([(tier, batch_id)], from_ts, to_ts)

    def _write(self, tier: str, rows: DataFrame, batch_id: str, part: str) -> None:
        """Write rows under a name that no earlier attempt had, and note which dates they went to."""
        attempt = f"{batch_id}.{uuid.uuid4().hex[:ATTEMPT]}"
        rows = rows.withColumn("batch_id", F.lit(attempt))
        # by part, with no pass before that samples the rows: few files per part, a part that holds most rows is
        # split, and many small ones are shared out; within a date ordered by identity, so that a series reads few pages
        order = ["dt", "identity_id", "bucket"] if part == "dt" else [part, "id"]
        spread = rows.hint("rebalance", F.col(part)).sortWithinPartitions(*order)
        spread.write.mode("append").options(**BLOOM).partitionBy(part, "batch_id").parquet(self._path(tier))
        written = session.matching(self.spark, f"{self._path(tier)}/dt=*/batch_id={attempt}")
        self._staged[tier, batch_id] = attempt, [date.fromisoformat(p.split("/dt=")[1][:10]) for p in written]

    def stage(self, tier: str, facts: DataFrame, batch_id: str) -> None:
        """Write a delta batch that does not count yet; rows a tier may not hold fail the write."""
        dt = tiers.folder_of(calendar.utc_date(F.col("bucket")), tier)
        rows = tiers.checked(facts).select(*schemas.TRAFFIC.fieldNames(), dt.alias("dt"))
        self._write(tier, rows, batch_id, "dt")

    def stage_identities(self, rows: DataFrame, batch_id: str, merged: bool = False) -> None:
        place = key_bucket() if merged else F.lit(RECENT)
        self._write(IDENTITY_TABLE, rows.select(*schemas.IDENTITY.fieldNames(), place.alias("bucket")), batch_id, "bucket")

    def stage_minutes(self, minutes: DataFrame, batch_id: str, settings: Settings, stage: Stage) -> list[tuple[str, str]]:
        """Stage minute facts and what they owe to coarser tiers.

        Rows below a tier's watermark would never be picked up by the rollup
        any more, so they are rolled up here, as part of the same batch.
        Returns what is to be committed.
        """
        deltas, marks = {"minute": stage(minutes, "minute_delta")}, self.marks()
        self.stage("minute", deltas["minute"], batch_id)
        staged = [("minute", batch_id)]
        for tier in TIERS[1:]:
            watermark = marks.get(("add", tier))
            if watermark is None:
                break
            source = deltas[tiers.source_of(tier, settings)]
            below = source.where(F.col("bucket") < calendar.at(watermark))
            if below.isEmpty():
                deltas[tier] = schemas.empty(self.spark, schemas.TRAFFIC)
                continue
            deltas[tier] = stage(tiers.roll(below, tier, settings.tz), f"{tier}_delta")
            self.stage(tier, deltas[tier], batch_id)
            staged.append((tier, batch_id))
        return staged

    def commit_batches(
        self, batches: list[tuple[str, str]], from_ts: datetime | None = None, to_ts: datetime | None = None,
        minutes_through: datetime | None = None, read: tuple[datetime, datetime] | None = None,
    ) -> None:
        """Make what was staged last under these names count, all of it or none.

        ``minutes_through`` says up to where the minute tier is complete, and
        ``read`` which stretch of landed samples the batch holds.
        """
        entries = []
        known = self.log().where(F.col("batch_id").isin([name for _, name in batches])).collect()
        for tier, name in batches:
            attempt, dates = self._staged.pop((tier, name), (None, []))
            top = self._highest(attempt) if tier == IDENTITY_TABLE and attempt else None
            mine = [r for r in known if (r.tier, r.batch_id) == (tier, name)]
            ends = minutes_through if tier == "minute" else to_ts
            entries.append(dict(tier=tier, action="add", batch_id=name, attempt=attempt, from_ts=from_ts, to_ts=ends, n=top))
            gone = {(r.attempt, r.dt) for r in mine if r.action == "drop"}
            before = {(r.attempt, r.dt) for r in mine if r.action == "lies"} - gone
            lies = [None] if tier == IDENTITY_TABLE else dates
            # rows that were merged with others count there, whatever is written again under their name
            merged = {d for a, d in gone if a is None and d is not None}
            entries += [dict(tier=tier, action="drop", batch_id=name, attempt=a, dt=d) for a, d in before]
            entries += [dict(tier=tier, action="lies", batch_id=name, attempt=attempt, dt=d) for d in lies if d not in merged]
        if read is not None:
            entries.append(dict(tier="samples", action="read", batch_id=batches[0][1], from_ts=read[0], to_ts=read[1]))
        self._commit(entries)

    # -- reading ------------------------------------------------------------

    def _folders(self, condition: Column) -> DataFrame:
        """(tier, batch_id, attempt, dt, seq) of the folders that count."""
        log = self.log().where(condition)
        gone = log.where((F.col("action") == "drop") & F.col("attempt").isNotNull()).select("tier", "attempt", "dt").distinct()
        lies = log.where(F.col("action") == "lies").groupBy("tier", "batch_id", "attempt", "dt").agg(F.max("seq").alias("seq"))
        same = [lies["tier"] == gone["tier"], lies["attempt"] == gone["attempt"], lies["dt"].eqNullSafe(gone["dt"])]
        return lies.join(gone, same, "left_anti")

    def _open(self, tier: str, schema: StructType, parts: list[str]) -> DataFrame:
        """Rows of named parts (dates or buckets) of a table; no other folder is listed."""
        table = self._path(tier)
        return self.spark.read.schema(schema).option("basePath", table).parquet(*[f"{table}/{p}" for p in parts])

    def read(self, spans: Sequence[Span], scope: str = ALL_SCOPES, of: Column | None = None) -> DataFrame:
        """Delta rows of some stretches, with one read of the log; ``of`` narrows by batch name.

        Folders are named before the scan, by date and batch, so that others
        are neither listed nor read.
        """
        pruned = self.marks()
        bounds = []
        for tier, start, end in spans:
            starts = [_utc(b) for b in (start, pruned.get(("prune", tier))) if b is not None]
            bounds.append((tier, max(starts, default=None), None if end is None else _utc(end)))
        wanted, reach = F.lit(False), {}
        for tier, start, end in bounds:
            first, last = (tiers.folder_date(m.date() if m else d, tier) for m, d in ((start, EARLIEST), (end, LATEST)))
            reach[tier, start, end] = first, last
            wanted |= (F.col("tier") == tier) & F.col("dt").between(F.lit(first), F.lit(last))
        live = self._folders(wanted).where(F.lit(True) if of is None else of).collect() if bounds else []
        parts = []
        for tier, start, end in bounds:
            first, last = reach[tier, start, end]
            here = [r for r in live if r.tier == tier and first <= r.dt <= last]
            if not here:
                continue
            rows = self._open(tier, schemas.TRAFFIC_STORED, sorted({f"dt={r.dt}" for r in here})).where(_among(here))
            bucket = F.col("bucket")
            rows = rows if start is None else rows.where(bucket >= calendar.at(start))
            parts.append(rows if end is None else rows.where(bucket < calendar.at(end)))
        found = reduce(DataFrame.unionByName, parts) if parts else schemas.empty(self.spark, schemas.TRAFFIC_STORED)
        return verbs.in_scope(found, scope)

    def deltas(self, tier: str, from_ts: datetime | None = None, to_ts: datetime | None = None,
               scope: str = ALL_SCOPES) -> DataFrame:
        """Delta rows of a window: enough for anything that sums."""
        return self.read([(tier, from_ts, to_ts)], scope)

    def scan(self, tier: str, from_ts: datetime | None = None, to_ts: datetime | None = None,
             scope: str = ALL_SCOPES) -> DataFrame:
        """One row per (bucket, identity, scope)."""
        return tiers.minute_merge(self.deltas(tier, from_ts, to_ts, scope))

    def batches_of(self, tier: str, stream: str, but_run: str, facts: DataFrame) -> DataFrame | None:
        """Delta rows of a stream's earlier runs in the buckets of ``facts``; None if there are none."""
        mine = F.col("batch_id").rlike(f"^{re.escape(stream)}-(?!{re.escape(but_run)}-)[0-9a-z]+-[0-9a-f]{{12}}$")
        if self.log().where(mine & (F.col("tier") == tier) & (F.col("action") == "lies")).isEmpty():
            return None
        first, last = facts.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(
            F.unix_micros("a"), F.unix_micros("b")).first()
        if first is None:
            return None
        start, end = (calendar.EPOCH + timedelta(microseconds=us) for us in (first, last + 1))
        return self.read([(tier, start, end)], of=mine)

    def identity_rows(self, keys: DataFrame | None = None) -> DataFrame:
        """Base and delta rows of the dimension, not merged yet; with ``keys`` from the parts that may hold those."""
        live = self._folders(F.col("tier") == IDENTITY_TABLE).select(F.col("attempt").alias("batch_id"), F.col("seq").alias("version"))
        found = session.folders(self.spark, self._path(IDENTITY_TABLE))
        if keys is not None:
            touched = {RECENT} | {r[0] for r in keys.select(key_bucket()).distinct().collect()}
            found = [p for p in found if int(p.partition("=")[2]) in touched]
        if not found:
            return schemas.empty(self.spark, schemas.IDENTITY).withColumn("version", F.lit(0).cast("long"))
        # later commits win over earlier ones, whatever the batches are called
        return self._open(IDENTITY_TABLE, schemas.IDENTITY_STORED, found).join(live, "batch_id").drop("batch_id", "bucket")

    def _highest(self, attempt: str) -> int | None:
        """The highest id that an attempt has written."""
        found = session.matching(self.spark, f"{self._path(IDENTITY_TABLE)}/bucket=*/batch_id={attempt}")
        return self.spark.read.schema(schemas.IDENTITY).parquet(*found).agg(F.max("id")).first()[0] if found else None

    def highest_id(self) -> int:
        return self.log().agg(F.max("n")).first()[0] or 0

    def identities(self) -> DataFrame:
        """Current state of the dimension."""
        return ids.identity_merge(self.identity_rows())

    # -- upkeep -------------------------------------------------------------

    def rollup(self, tier: str, now: datetime, settings: Settings, complete_through: datetime | None = None) -> bool:
        """Roll closed finer buckets past the watermark into ``tier``.

        No further than the source tier itself has got.  ``complete_through``
        holds the bound back when the finer tier is still being fed behind the
        clock.  A second run with nothing new does nothing.
        """
        source, tz, marks = tiers.source_of(tier, settings), settings.tz, self.marks()
        after = marks.get(("add", tier))
        through = tiers.closed_bound(tier, now, tz, source)
        if source != "minute":
            fed = marks.get(("add", source))
            if fed is None:
                return False
            through = min(through, tiers.closed_bound(tier, fed, tz, source))
        if complete_through is not None:
            through = min(through, tiers.closed_bound(tier, complete_through, tz, source))
        if after is not None and through <= after:
            return False
        delta = tiers.roll(self.deltas(source, after, through), tier, tz)
        self.append(tier, delta, f"roll-{_stamp(after)}-{_stamp(through)}", after, through)
        return True

    def prune(self, tier: str, now: datetime, settings: Settings) -> datetime | None:
        """Remove rows past retention, but none that was not rolled up: whole folders; a bound hides the rest."""
        marks = self.marks()
        fed = [marks.get(("add", coarse)) for coarse in TIERS[1:] if tiers.source_of(coarse, settings) == tier]
        bound = tiers.prune_bound(tier, _utc(now), settings, min(fed) if fed and None not in fed else None)
        before = marks.get(("prune", tier))
        if bound is not None and (before is None or bound > before):
            self._commit([dict(tier=tier, action="prune", to_ts=bound)])
            before = bound
        if before is not None:
            # dates that nobody can ask for any more; of the first date that stays the bound hides a part
            first = f"dt={tiers.folder_date(before.date(), tier)}"
            session.remove(self.spark, [p for p in session.matching(self.spark, f"{self._path(tier)}/dt=*") if p.rpartition("/")[2] < first])
        return before

    def compact(self, tier: str, *dates: date) -> list[str]:
        """Rewrite the deltas of closed dates as one for each date, and for each stream that wrote to it.

        A stream's rows stay known as its own, because a run that starts anew
        adds only what its earlier runs did not write.
        """
        kept = self.pruned_through(tier)
        dates = [d for d in dates if kept is None or d >= tiers.folder_date(kept.date(), tier)]
        live = self._folders((F.col("tier") == tier) & F.col("dt").isin(dates)).collect()
        stream = lambda name: (re.match(STREAM_BATCH, name) or ["", ""])[1]
        done = []
        for origin in sorted({stream(r.batch_id) for r in live}):
            old = [r for r in live if stream(r.batch_id) == origin]
            old = [r for r in old if sum(o.dt == r.dt for o in old) > 1]
            if not old:
                continue
            rows = self._open(tier, schemas.TRAFFIC_STORED, sorted({f"dt={r.dt}" for r in old})).where(_among(old))
            name = f"{origin}-merged-{uuid.uuid4().hex[:12]}"
            self.stage(tier, tiers.minute_merge(rows), name)
            attempt, written = self._staged.pop((tier, name))
            self._commit(
                [dict(tier=tier, action="add", batch_id=name, attempt=attempt)]
                + [dict(tier=tier, action="lies", batch_id=name, attempt=attempt, dt=d) for d in written]
                + [dict(tier=tier, action="drop", batch_id=r.batch_id, attempt=a, dt=r.dt) for r in old for a in (r.attempt, None)])
            done.append(name)
        return done

    def compact_identities(self) -> str | None:
        """Rewrite base and deltas of the dimension as one base, in parts by key."""
        old = self._folders(F.col("tier") == IDENTITY_TABLE).collect()
        if len(old) < 2:
            return None
        name = f"merged-{uuid.uuid4().hex[:12]}"
        self.stage_identities(self.identities(), name, merged=True)
        attempt, _ = self._staged.pop((IDENTITY_TABLE, name))
        entry = dict(tier=IDENTITY_TABLE, batch_id=name, attempt=attempt)
        self._commit([entry | dict(action="add", n=self._highest(attempt)), entry | dict(action="lies")]
                     + [dict(tier=IDENTITY_TABLE, action="drop", batch_id=r.batch_id, attempt=r.attempt) for r in old])
        return name

    def vacuum(self, tier: str) -> list[str]:
        """Remove folders no reader looks at: merged, replaced, never committed.

        What is staged under a name of this store object is left alone: its
        batch may be about to commit.
        """
        table = self._path(tier)
        live = self._folders(F.col("tier") == tier).select("dt", "attempt").collect()
        open_ = {attempt for (of, _), (attempt, _) in self._staged.items() if of == tier}
        keep = {(f"dt={r.dt}" if r.dt else None, f"batch_id={r.attempt}") for r in live}
        gone = [
            f"{table}/{part}/{folder}" for part in session.folders(self.spark, table)
            for folder in session.folders(self.spark, f"{table}/{part}")
            if not {(part, folder), (None, folder)} & keep and folder.partition("=")[2] not in open_
        ]
        session.remove(self.spark, gone)
        return gone

    def maintain(self, now: datetime, settings: Settings, complete_through: datetime | None = None) -> None:
        """Rollup of every tier, fine to coarse, then retention; from time to time fewer folders and one file for the log."""
        for tier in TIERS[1:]:
            self.rollup(tier, now, settings, complete_through)
        for tier in TIERS:
            self.prune(tier, now, settings)
        if len(session.folders(self.spark, self._path("commit_log"), files=True)) >= LOG_FILES:
            for tier in TIERS:
                self.vacuum(tier)  # before merging, so that what is merged now stays for readers until the next time
                full = self._folders((F.col("tier") == tier) & (F.col("dt") < F.lit(_utc(now).date()))).groupBy("dt").count()
                self.compact(tier, *[r.dt for r in full.where(F.col("count") >= FOLDERS).collect()])
            self.vacuum(IDENTITY_TABLE)
            self.compact_identities()
            self.compact_log()


def key_bucket() -> Column:
    return F.pmod(F.xxhash64(*NATURAL_KEY), F.lit(BUCKETS)).cast("int")


def _among(live: Sequence[Row]) -> Column:
    """Rows of these (dt, attempt) folders, where no other dates are opened: attempts by the stretch of dates they share."""
    place = {dt: n for n, dt in enumerate(sorted({r.dt for r in live}))}
    dates, stretches = list(place), {}
    for attempt, lie in groupby(sorted({(r.attempt, r.dt) for r in live}), key=lambda pair: pair[0]):
        # dates that follow each other among those opened are one stretch
        for _, run in groupby(enumerate(place[dt] for _, dt in lie), key=lambda pair: pair[1] - pair[0]):
            within = [n for _, n in run]
            stretches.setdefault((dates[within[0]], dates[within[-1]]), []).append(attempt)
    dt = F.col("dt")
    return reduce(Column.__or__, [dt.between(F.lit(a), F.lit(b)) & F.col("batch_id").isin(of) for (a, b), of in stretches.items()])


def _utc(moment: datetime) -> datetime:
    return moment.astimezone(timezone.utc) if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def _stamp(moment: datetime | None) -> str:
    return "start" if moment is None else f"{_utc(moment):%Y%m%dT%H%M%S}"
