import os
from datetime import date, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from bytewake import schemas
from bytewake.config import Settings
from bytewake.operators import tiers
from bytewake.plans.attribution import ingest
from bytewake.plans.reconcile import reconcile
from bytewake.session import folders, matching, remove
from bytewake.sources.store import Store, _among
from tests.conftest import rows_of, utc
from tests.test_identity import feeds, snapshot
from tests.test_samples import sample
from tests.test_tiers import facts, stamped

NOON = utc(2026, 7, 6, 12)


def minutes(spark, start, count, step=1, value=1):
    return facts(spark, *[(start + timedelta(minutes=step * i), i % 3, "external", value, 2 * value) for i in range(count)])


def test_repeated_batch_replaces_itself(spark, root):
    store = Store(spark, root)
    delta = facts(spark, (NOON, 1, "external", 100, 50))
    store.append("minute", delta, "a")
    store.append("minute", delta, "a")
    assert stamped(store.scan("minute")) == [("2026-07-06 12:00", 1, "external", 100, 50)]
    store.append("minute", facts(spark, (NOON, 1, "external", 20, 5)), "b")
    assert stamped(store.scan("minute")) == [("2026-07-06 12:00", 1, "external", 120, 55)]


def test_uncommitted_batch_is_invisible(spark, root):
    store = Store(spark, root)
    assert store.scan("minute").count() == 0
    store.stage("minute", facts(spark, (NOON, 1, "external", 1, 1)), "a")
    assert store.scan("minute").count() == 0
    store.commit_batches([("minute", "a")])
    assert store.scan("minute").count() == 1


def test_scan_window_is_half_open(spark, root):
    store = Store(spark, root)
    store.append("minute", minutes(spark, utc(2026, 7, 6, 23, 58), 4), "a")
    got = store.scan("minute", utc(2026, 7, 6, 23, 59), utc(2026, 7, 7, 0, 1))
    assert [r[0] for r in stamped(got)] == ["2026-07-06 23:59", "2026-07-07 00:00"]


def test_watermark_round_trip(spark, root):
    store = Store(spark, root)
    assert store.watermark("hour") is None
    store.commit_batches([("hour", "r1")], None, utc(2026, 7, 6, 11))
    store.commit_batches([("hour", "r2")], utc(2026, 7, 6, 11), utc(2026, 7, 6, 12))
    assert store.watermark("hour") == utc(2026, 7, 6, 12)
    assert store.watermark("day") is None


def test_rollup_is_idempotent_and_catches_up(spark, root):
    store = Store(spark, root)
    source = minutes(spark, NOON, 400, step=17)
    store.append("minute", source, "a")
    now = NOON + timedelta(hours=20, minutes=1, seconds=5)
    assert store.rollup("hour", now, Settings())
    assert not store.rollup("hour", now, Settings())
    assert store.rollup("hour", NOON + timedelta(days=9), Settings())
    want = tiers.rollup(source, "hour", NOON + timedelta(days=9), "UTC")
    assert stamped(store.scan("hour")) == stamped(want)


def test_rollup_waits_for_a_slow_feed(spark, root):
    store = Store(spark, root)
    store.append("minute", minutes(spark, NOON, 10), "a")
    now = NOON + timedelta(hours=5)
    store.rollup("hour", now, Settings(), complete_through=NOON + timedelta(minutes=4))
    assert store.watermark("hour") == NOON + timedelta(minutes=4)
    store.append("minute", facts(spark, (NOON + timedelta(minutes=5), 1, "external", 100, 0)), "slow")
    store.rollup("hour", now, Settings())
    assert store.scan("hour").agg(F.sum("ingress_bytes")).first()[0] == 110


def test_attempt_that_never_committed_does_not_count(spark, root):
    store = Store(spark, root)
    store.append("minute", minutes(spark, NOON, 10), "a")
    lost = tiers.roll(store.deltas("minute"), "hour", "UTC")
    store.stage("hour", lost, "roll-start-lost")
    store.rollup("hour", NOON + timedelta(hours=3), Settings())
    assert store.scan("hour").agg(F.sum("ingress_bytes")).first()[0] == 10


def test_compaction_changes_no_result(spark, root):
    store = Store(spark, root)
    for name in "abc":
        store.append("minute", minutes(spark, utc(2026, 7, 6, 23, 50), 20), name)
    before = stamped(store.scan("minute"))
    assert store.compact("minute", date(2026, 7, 6))
    assert not store.compact("minute", date(2026, 7, 6))
    assert stamped(store.scan("minute")) == before
    live = store.deltas("minute").select("dt", "batch_id").distinct()
    assert live.where(F.col("dt") == F.lit(date(2026, 7, 6))).count() == 1
    assert live.where(F.col("dt") == F.lit(date(2026, 7, 7))).count() == 3
    # a batch that is written again after it was merged stays merged
    store.append("minute", minutes(spark, utc(2026, 7, 6, 23, 50), 20), "c")
    assert stamped(store.scan("minute")) == before
    store.stage("minute", minutes(spark, utc(2026, 7, 6, 23, 50), 20), "never-committed")
    assert len(store.vacuum("minute")) == 5
    assert stamped(store.scan("minute")) == before


def test_prune_is_exact_and_keeps_what_is_not_rolled_up(spark, root):
    store, settings = Store(spark, root), Settings()
    store.append("minute", minutes(spark, utc(2026, 7, 1), 10 * 24, step=60), "a")
    now = utc(2026, 7, 11, 6, 30)
    assert store.prune("minute", now, settings) is None
    store.maintain(now, settings)
    # 48 hours before now, to the minute
    assert min(stamped(store.scan("minute")))[0] == "2026-07-09 07:00"
    assert store.scan("hour").agg(F.sum("ingress_bytes")).first()[0] == 240
    assert folders(spark, f"{root}/traffic_minute")[0] == "dt=2026-07-09"
    assert len(folders(spark, f"{root}/traffic_hour")) == 10
    assert min(stamped(store.scan("minute")))[0] == "2026-07-09 07:00"
    store.maintain(now, settings)
    assert store.scan("day").agg(F.sum("ingress_bytes")).first()[0] == 240
    assert store.scan("month").agg(F.sum("ingress_bytes")).first()[0] == 240


def world(spark, samples):
    return feeds(
        spark, samples=samples,
        snapshots=[snapshot(1, utc(2024, 1, 1)), snapshot(1, utc(2024, 1, 1, 10, 0, 30), cmdline="cargo\0watch\0docs")],
        meta=[("h", 2, 1000, "7", "rsync\0", utc(2024, 1, 1))],
        passwd=[("h", 1, 1000, "x")], markers=[("h", "/home/x", ".git")],
    )


def named(store, tier):
    names = store.identities().select(F.col("id").alias("identity_id"), "normalized_cmdline")
    joined = store.scan(tier).join(names, "identity_id")
    return sorted(
        (r.normalized_cmdline, r.b, r.ingress_bytes, r.egress_bytes)
        for r in joined.withColumn("b", F.date_format("bucket", "dd HH:mm")).collect()
    )


FIRST = [
    sample(1, utc(2024, 1, 1, 10, 0, 10), 1, "tcp_sendmsg", 5),
    sample(2, utc(2024, 1, 1, 10, 0, 50), 1, "tcp_sendmsg", 7),
    sample(3, utc(2024, 1, 1, 9, 0, 1), 2, "udp_recvmsg", 11),
]
LATE = [
    sample(4, utc(2024, 1, 1, 10, 0, 20), 1, "tcp_sendmsg", 100),
    sample(5, utc(2024, 1, 1, 9, 0, 2), 3, "udp_recvmsg", 1000),
]


def test_ingest_twice_and_in_parts(spark, root):
    store = Store(spark, root)
    ingest(spark, store, world(spark, FIRST), "a", Settings())
    ingest(spark, store, world(spark, FIRST), "a", Settings())
    want = [
        ("<unresolved:rsync>", "01 09:00", 11, 0),
        ("cargo watch docs", "01 10:00", 0, 7),
        ("cargo watch lint", "01 10:00", 0, 5),
    ]
    assert named(store, "minute") == want
    ids_before = dict(rows_of(store.identities(), "normalized_cmdline", "id"))
    ingest(spark, store, world(spark, LATE), "b", Settings())
    assert named(store, "minute") == sorted(
        [want[0], want[1], ("cargo watch lint", "01 10:00", 0, 105), ("<unresolved>", "01 09:00", 1000, 0)])
    after = dict(rows_of(store.identities(), "normalized_cmdline", "id"))
    assert {k: after[k] for k in ids_before} == ids_before
    assert store.compact_identities()
    assert dict(rows_of(store.identities(), "normalized_cmdline", "id")) == after


def test_reconcile_reaches_every_tier_once(spark, root):
    store = Store(spark, root)
    ingest(spark, store, world(spark, FIRST), "a", Settings())
    settings = Settings()
    now = utc(2024, 1, 2, 12)
    store.maintain(now, settings)
    everything = world(spark, FIRST + LATE)
    reconcile(spark, store, everything, "fix-1", utc(2024, 1, 1), utc(2024, 1, 2), settings)
    want = [
        ("<unresolved:rsync>", 11, 0), ("<unresolved>", 1000, 0), ("cargo watch docs", 0, 7), ("cargo watch lint", 0, 105),
    ]
    for tier in ("minute", "hour", "day"):
        assert [(k, i, e) for k, _, i, e in named(store, tier)] == sorted(want), tier
    with pytest.raises(ValueError):
        reconcile(spark, store, everything, "fix-1", utc(2024, 1, 1), utc(2024, 1, 2), settings)
    reconcile(spark, store, everything, "fix-2", utc(2024, 1, 1), utc(2024, 1, 2), settings)
    store.maintain(now + timedelta(days=40), settings)
    for tier in ("hour", "day", "month"):
        assert [(k, i, e) for k, _, i, e in named(store, tier)] == sorted(want), tier


def test_reconcile_leaves_pruned_minutes_alone(spark, root):
    store = Store(spark, root)
    ingest(spark, store, world(spark, FIRST), "a", Settings())
    store.maintain(utc(2024, 1, 3, 9, 30), Settings())
    assert [k for k, *_ in named(store, "minute")] == ["cargo watch docs", "cargo watch lint"]
    reconcile(spark, store, world(spark, FIRST + LATE), "fix", utc(2024, 1, 1), utc(2024, 1, 3), Settings())
    assert ("<unresolved:rsync>", "01 09:00", 11, 0) in named(store, "hour")
    assert ("cargo watch lint", "01 10:00", 0, 105) in named(store, "hour")
    assert sum(r[2] for r in named(store, "hour")) == 11


def test_exact_days_come_from_minutes(spark, root):
    store, settings = Store(spark, root), Settings(tz="Asia/Kolkata", exact_days=True)
    # local midnight is 18:30 UTC
    store.append("minute", facts(spark, (utc(2024, 1, 1, 18, 10), 1, "external", 1, 0),
                                 (utc(2024, 1, 1, 18, 40), 1, "external", 2, 0)), "a")
    store.maintain(utc(2024, 1, 1, 18, 45, 30), settings)
    assert store.watermark("day") == utc(2024, 1, 1, 18, 45)
    store.append("minute", facts(spark, (utc(2024, 1, 1, 18, 50), 1, "external", 4, 0)), "b")
    store.maintain(utc(2024, 1, 9), settings)
    assert stamped(store.scan("day")) == [
        ("2023-12-31 18:30", 1, "external", 1, 0), ("2024-01-01 18:30", 1, "external", 6, 0)]
    assert store.scan("minute").count() == 0


def test_log_compaction_changes_no_result(spark, root):
    store = Store(spark, root)
    for i in range(4):
        store.append("minute", facts(spark, (NOON, i, "external", 1, 1)), f"b{i}")
    store.rollup("hour", NOON + timedelta(hours=3), Settings())
    before = stamped(store.scan("minute")), stamped(store.scan("hour")), store.watermark("hour")
    store.compact_log()
    assert len(store.log().inputFiles()) == 1
    assert (stamped(store.scan("minute")), stamped(store.scan("hour")), store.watermark("hour")) == before


def test_late_batch_reaches_every_tier(spark, root):
    store, settings = Store(spark, root), Settings()
    ingest(spark, store, world(spark, FIRST), "a", settings)
    store.maintain(utc(2024, 1, 2, 12), settings)
    ingest(spark, store, world(spark, LATE), "b", settings)
    ingest(spark, store, world(spark, LATE), "b", settings)
    store.maintain(utc(2024, 1, 2, 13), settings)
    want = sorted([
        ("<unresolved:rsync>", 11, 0), ("<unresolved>", 1000, 0), ("cargo watch docs", 0, 7), ("cargo watch lint", 0, 105)])
    for tier in ("minute", "hour", "day"):
        assert [(k, i, e) for k, _, i, e in named(store, tier)] == want, tier


def test_days_wait_for_their_hours(spark, root):
    store, settings = Store(spark, root), Settings()
    store.append("minute", minutes(spark, NOON, 10), "a")
    assert not store.rollup("day", NOON + timedelta(days=2), settings)
    store.rollup("hour", NOON + timedelta(minutes=4), settings)
    store.rollup("day", NOON + timedelta(days=2), settings)
    assert store.scan("day").count() == 0
    store.maintain(NOON + timedelta(days=2), settings)
    assert store.scan("day").agg(F.sum("ingress_bytes")).first()[0] == 10


def test_batch_that_failed_before_its_commit_can_be_repeated(spark, root):
    store, settings = Store(spark, root), Settings()
    commit, store.commit_batches = store.commit_batches, lambda *a, **k: None
    ingest(spark, store, world(spark, FIRST), "a", settings)
    store.commit_batches = commit
    assert store.scan("minute").count() == 0
    ingest(spark, store, world(spark, LATE), "b", settings)
    ingest(spark, store, world(spark, FIRST), "a", settings)
    rows = rows_of(store.identities(), "id", "normalized_cmdline")
    assert len({i for i, _ in rows}) == len(rows) == 4
    assert sum(r[2] + r[3] for r in named(store, "minute")) == 5 + 7 + 11 + 1100


def died(*args, **kwargs):
    raise RuntimeError("died")


def total(store, tier="minute", *window):
    return store.scan(tier, *window).agg(F.sum("ingress_bytes")).first()[0]


TWO_DAYS = [(utc(2026, 7, 6, 10), 1, "external", 10, 0), (utc(2026, 7, 7, 10), 1, "external", 20, 0)]


def test_compaction_that_dies_before_its_commit_counts_nothing(spark, root):
    store = Store(spark, root)
    for name in ("a", "b"):
        store.append("minute", facts(spark, *TWO_DAYS), name)
    assert store.compact("minute", date(2026, 7, 6))
    commit, store._commit = store._commit, died
    with pytest.raises(RuntimeError):
        store.compact("minute", date(2026, 7, 7))
    store._commit = commit
    assert total(store) == 60
    store = Store(spark, root)
    assert store.compact("minute", date(2026, 7, 7))
    assert total(store) == 60
    store.vacuum("minute")
    assert total(store) == 60


def test_retry_does_not_inherit_dates_of_a_failed_attempt(spark, root):
    store = Store(spark, root)
    store.append("minute", facts(spark, TWO_DAYS[1]), "other")
    store.stage("minute", facts(spark, *TWO_DAYS), "a")
    store.append("minute", facts(spark, TWO_DAYS[0]), "a")
    assert total(store, "minute", utc(2026, 7, 7), utc(2026, 7, 8)) == 20
    # the same after a commit: the later attempt is the batch
    store.append("minute", facts(spark, *TWO_DAYS), "a")
    assert total(store) == 50
    store.append("minute", facts(spark, TWO_DAYS[0]), "a")
    assert total(store) == 30


def test_vacuum_leaves_a_batch_that_is_being_written(spark, root):
    store = Store(spark, root)
    store.stage("minute", facts(spark, *TWO_DAYS), "a")
    assert store.vacuum("minute") == []
    store.commit_batches([("minute", "a")])
    assert total(store) == 30


@pytest.mark.parametrize("row", [
    (NOON, 1, "lan", 1, 1), (NOON, 1, None, 1, 1), (NOON, None, "external", 1, 1), (NOON, 1, "external", None, 1)])
def test_rows_that_a_tier_may_not_hold_are_refused(spark, root, row):
    store = Store(spark, root)
    with pytest.raises(Exception, match="not a tier row"):
        store.append("minute", facts(spark, row), "a")
    assert store.scan("minute").count() == 0


def test_other_session_zones_are_refused(spark, root):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        with pytest.raises(ValueError):
            Store(spark, root)
        with pytest.raises(ValueError):
            tiers.roll(facts(spark, TWO_DAYS[0]), "day", "Europe/Berlin")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_daily_windows_of_one_landing_folder_count_once(spark, root):
    every = [sample(i, utc(2024, 1, 1 + i % 2, 10, i), 1, "tcp_sendmsg", 10 + i) for i in range(6)]
    store, both = Store(spark, root), Store(spark, root + "-both")
    days = [(utc(2024, 1, d), utc(2024, 1, d + 1)) for d in (1, 2)]
    for window in days:
        ingest(spark, store, world(spark, every), f"{window[0]:%F}", Settings(), window)
    ingest(spark, both, world(spark, every), "both", Settings(), (days[0][0], days[1][1]))
    assert named(store, "minute") == named(both, "minute") and len(named(store, "minute")) == 6
    with pytest.raises(ValueError, match="2024-01-02"):
        ingest(spark, store, world(spark, every), "again", Settings(), (utc(2024, 1, 2, 5), utc(2024, 1, 3)))
    ingest(spark, store, world(spark, every), "2024-01-02", Settings(), days[1])
    assert named(store, "minute") == named(both, "minute")


def test_known_name_with_another_window_is_refused(spark, root):
    store = Store(spark, root)
    every = [sample(i, utc(2024, 1, 1 + i % 2, 10, i), 1, "tcp_sendmsg", 10 + i) for i in range(6)]
    days = [(utc(2024, 1, d), utc(2024, 1, d + 1)) for d in (1, 2)]
    ingest(spark, store, world(spark, every), "nightly", Settings(), days[0])
    with pytest.raises(ValueError, match="nightly"):
        ingest(spark, store, world(spark, every), "nightly", Settings(), days[1])
    with pytest.raises(ValueError, match="nightly"):
        ingest(spark, store, world(spark, every), "nightly", Settings())
    ingest(spark, store, world(spark, every), "nightly", Settings(), days[0])
    ingest(spark, store, world(spark, every), "second", Settings(), days[1])
    assert sum(e for *_, e in named(store, "minute")) == sum(10 + i for i in range(6))


def test_retention_removes_dates_and_the_log_forgets_them(spark, root):
    store, settings = Store(spark, root), Settings()
    store.append("minute", minutes(spark, utc(2026, 6, 1), 40, step=24 * 60), "a")
    now = utc(2026, 7, 11)
    store.maintain(now, settings)
    assert folders(spark, f"{root}/traffic_minute") == ["dt=2026-07-09", "dt=2026-07-10"]
    hours = stamped(store.scan("hour"))
    store.maintain(now + timedelta(days=300), settings)
    assert folders(spark, f"{root}/traffic_minute") == [] == folders(spark, f"{root}/traffic_hour")
    assert len(hours) == store.scan("day").count() == 40 and store.scan("minute").count() == 0
    # a late row of a date that is gone is rolled up and not asked for
    store.append("minute", minutes(spark, utc(2026, 6, 3), 1), "late")
    assert store.scan("minute").count() == 0
    store.compact_log()
    assert store.log().where(F.col("dt").isNotNull() & (F.col("tier") == "minute")).isEmpty()
    assert store.scan("day").count() == 40 and store.committed("a")


def test_merged_dates_of_a_stream_stay_its_own(spark, root, monkeypatch):
    monkeypatch.setattr("bytewake.sources.store.FOLDERS", 2)
    monkeypatch.setattr("bytewake.sources.store.LOG_FILES", 3)
    store, day = Store(spark, root), utc(2026, 7, 6)
    for run, stream in (("aaaaaaaaaaaa", "live"), ("bbbbbbbbbbbb", "live-eu")):
        for n in range(3):
            store.append("minute", minutes(spark, day + timedelta(hours=n), 2), f"{stream}-{run}-{n:012d}")
    store.append("minute", minutes(spark, day, 1, value=7), "nightly")
    before = stamped(store.scan("minute"))
    store.maintain(day + timedelta(days=1, hours=1), Settings())
    store.vacuum("minute")
    assert stamped(store.scan("minute")) == before
    # one folder for each stream and one for the batch that is alone
    assert len(folders(spark, f"{root}/traffic_minute/dt=2026-07-06")) == 3
    again = minutes(spark, day, 2)
    mine = store.batches_of("minute", "live", "cccccccccccc", again)
    assert mine.agg(F.sum("ingress_bytes")).first()[0] == 2
    assert store.batches_of("minute", "other", "cccccccccccc", again) is None


def test_process_that_does_not_change_is_written_once(spark, root):
    store = Store(spark, root)
    for i in range(3):
        rows = [sample(i, utc(2024, 1, 1, 10, 1 + i), 1, "tcp_sendmsg", 5)]
        ingest(spark, store, world(spark, rows), f"b{i}", Settings())
    rows = store.identity_rows().groupBy("normalized_cmdline").count().collect()
    assert [r["count"] for r in rows] == [1]
    assert sum(r[3] for r in named(store, "minute")) == 15


def test_later_commit_wins_a_tie_whatever_its_name(spark, root):
    store = Store(spark, root)
    row = dict(id=1, host="h", uid=1, unit_or_cgroup="u", exe="e", project_root="p", normalized_cmdline="n", comm="c",
               raw_cmdline="r", first_seen=NOON, last_seen=NOON)
    for batch, name in (("merge-z", "old"), ("live-a", "new")):
        store.stage_identities(spark.createDataFrame([{**row, "username": name}], schemas.IDENTITY), batch)
        store.commit_batches([("identity", batch)])
    assert store.identities().first()["username"] == "new"


def test_upkeep_bounds_log_and_dimension(spark, root, monkeypatch):
    monkeypatch.setattr("bytewake.sources.store.LOG_FILES", 5)
    store = Store(spark, root)
    row = dict(id=1, host="h", uid=1, unit_or_cgroup="u", exe="e", project_root="p", normalized_cmdline="n", comm="c",
               raw_cmdline="r", first_seen=NOON)
    for i in range(12):
        seen = {**row, "username": f"user{i}", "last_seen": NOON + timedelta(minutes=i)}
        store.stage_identities(spark.createDataFrame([seen], schemas.IDENTITY), f"b{i}")
        store.stage("minute", facts(spark, (NOON + timedelta(minutes=i), 1, "external", 1, 1)), f"b{i}")
        store.commit_batches([("identity", f"b{i}"), ("minute", f"b{i}")])
        store.maintain(NOON, Settings())
        assert len(store.log().inputFiles()) <= 6 and store.identity_rows().count() <= 6
    assert store.identities().first()["username"] == "user11"
    assert sum(r[3] for r in stamped(store.scan("minute"))) == 12 and all(store.committed(f"b{i}") for i in range(12))
    # a batch that is written again after it was merged is not lost
    again = {**row, "username": "again", "last_seen": NOON + timedelta(hours=1)}
    store.stage_identities(spark.createDataFrame([again], schemas.IDENTITY), "b0")
    store.commit_batches([("identity", "b0")])
    assert store.identities().first()["username"] == "again"


def test_no_byte_is_lost_to_missing_fields(spark, root):
    store = Store(spark, root)
    rows = [list(sample(i, utc(2024, 1, 1, 9, i), 2, "udp_recvmsg", 10)) for i in range(4)]
    rows[1][2], rows[2][3] = None, None
    feed = feeds(spark, samples=[tuple(r) for r in rows], meta=[("h", 2, 1000, "7", None, utc(2024, 1, 1))])
    ingest(spark, store, feed, "a", Settings())
    ingest(spark, store, feed, "b", Settings())
    assert total(store) == 80
    assert store.identities().count() == 2


def test_reused_process_number_with_captures_only(spark, root):
    store = Store(spark, root)
    meta = [("h", 2, 1000, "7", "first\0", utc(2024, 1, 1)), ("h", 2, 2000, "7", "second\0", utc(2024, 1, 1, 12))]
    rows = [sample(1, utc(2024, 1, 1, 11), 2, "udp_recvmsg", 10), sample(2, utc(2024, 1, 1, 12, 0, 1), 2, "udp_recvmsg", 20)]
    # a snapshot, then a capture of another process under its number
    rows += [sample(3, utc(2024, 1, 1, 11), 5, "udp_recvmsg", 30), sample(4, utc(2024, 1, 1, 13), 5, "udp_recvmsg", 40)]
    meta += [("h", 5, 1000, "7", "node\0", utc(2024, 1, 1, 10, 0, 5)), ("h", 5, 3000, "7", "third\0", utc(2024, 1, 1, 12))]
    feed = feeds(spark, samples=rows, snapshots=[snapshot(5, utc(2024, 1, 1, 10))], meta=meta)
    ingest(spark, store, feed, "a", Settings())
    assert [(n, i) for n, _, i, _ in named(store, "minute")] == [
        ("<unresolved:first>", 10), ("<unresolved:second>", 20), ("<unresolved:third>", 40), ("cargo watch lint", 30)]


def test_rows_are_computed_once_to_be_written(spark, root):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(value):
        seen.add(1)
        return value

    store = Store(spark, root)
    rows = minutes(spark, NOON, 100).repartition(4).withColumn("ingress_bytes", counted("ingress_bytes"))
    store.append("minute", rows, "a")
    assert seen.value == 100
    assert store.scan("minute").count() == 100


def test_busy_date_is_shared_out(spark, root):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        store = Store(spark, root)
        busy = spark.range(60000).select(
            F.lit(NOON).cast("timestamp").alias("bucket"), F.xxhash64("id").alias("identity_id"), F.lit("external").alias("scope"),
            F.col("id").alias("ingress_bytes"), F.lit(0).cast("long").alias("egress_bytes"))
        quiet = minutes(spark, NOON - timedelta(days=1), 10)
        store.append("minute", busy.repartition(8).unionByName(quiet), "a")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    rows = store.scan("minute")
    assert (rows.count(), rows.agg(F.sum("ingress_bytes")).first()[0]) == (60010, 59999 * 30000 + 10)
    files = store.deltas("minute").select("dt", F.input_file_name().alias("file")).distinct().groupBy("dt").count()
    assert {str(r.dt): r["count"] > 2 for r in files.collect()} == {"2026-07-05": False, "2026-07-06": True}


def test_folders_of_a_large_batch_are_named_by_stretches(spark):
    days = [date(2026, 7, 6) + timedelta(days=n) for n in (0, 1, 2, 5, 6, 9, 10, 11, 12)]
    live = [Row(attempt="all", dt=d) for d in days if d != days[4]]  # of one date it was merged
    live += [Row(attempt=a, dt=days[n]) for a, n in (("b", 4), ("c", 4), ("c", 0), ("d", 8), ("c", 8), ("e", 3), ("e", 5))]
    every = spark.createDataFrame([(a, d) for a in ("all", "b", "c", "d", "e", "f") for d in days], "batch_id string, dt date")
    named = _among(live)
    assert rows_of(every.where(named)) == sorted(((r.attempt, r.dt) for r in live), key=repr)
    wide = [Row(attempt="all", dt=date(2000, 1, 1) + timedelta(days=2 * n)) for n in range(1000)]
    assert len(str(_among(wide))) < 300


def test_many_folders_are_found_and_removed(spark, tmp_path):
    for number in range(20):
        (tmp_path / f"a, b/dt={number:02}" / "batch_id=x").mkdir(parents=True)
    (tmp_path / "a, b" / "dt=00" / "batch_id=y,z").mkdir()
    found = matching(spark, f"{tmp_path}/a, b/dt=*/batch_id=x")
    assert found == [f"file:{tmp_path}/a, b/dt={number:02}/batch_id=x" for number in range(20)]
    assert matching(spark, f"{tmp_path}/a, b/dt=00/batch_id=y,z") == [f"file:{tmp_path}/a, b/dt=00/batch_id=y,z"]
    assert matching(spark, f"{tmp_path}/none/dt=*") == []
    remove(spark, found)
    assert [x for x in found if os.path.exists(x.removeprefix("file:"))] == []
    assert len(folders(spark, f"{tmp_path}/a, b")) == 20
