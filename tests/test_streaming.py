import random
from datetime import timedelta

from pyspark.sql import functions as F

from bytewake import schemas
from bytewake.config import Settings
from bytewake.operators import samples as smp
from bytewake.plans.reader import Reader
from bytewake.plans.reconcile import reconcile
from bytewake.sources import landing
from bytewake.sources.store import Store
from bytewake.streaming import live
from tests.conftest import rows_of, utc
from tests.test_identity import feeds, snapshot
from tests.test_samples import sample

START = utc(2024, 1, 1)
DELAY = timedelta(minutes=2)


def land(spark, path, files):
    """One file per micro-batch, in order."""
    for number, rows in enumerate(files):
        df = spark.createDataFrame(rows, schemas.SOCKET_SAMPLE)
        df.coalesce(1).write.mode("append").parquet(path)


def run(writer, checkpoint):
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def traffic(seed, minutes, per_minute=20):
    """Files of five minutes each, in time order."""
    rng = random.Random(seed)
    files, i = [], 0
    for first in range(0, minutes, 5):
        rows = []
        for minute in range(first, first + 5):
            for _ in range(per_minute):
                i += 1
                ts = START + timedelta(minutes=minute, seconds=rng.randrange(60))
                rows.append(sample(i, ts, rng.randrange(4), rng.choice(["tcp_sendmsg", "udp_recvmsg"]), rng.randint(-2, 9)))
        files.append(rows)
    return files


def folded(df):
    return rows_of(df.select(F.unix_seconds("bucket").alias("b"), "tgid", "scope", "ingress_bytes", "egress_bytes"))


def test_closed_minutes_over_many_batches(spark, tmp_path):
    files = traffic(1, 30)
    land(spark, f"{tmp_path}/in", files)
    stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=1)
    minutes = live.stream_minute_fold(stream, DELAY)
    run(minutes.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    every = spark.createDataFrame([r for f in files for r in f], schemas.SOCKET_SAMPLE)
    last = max(r[1] for f in files for r in f if r[5] > 0)
    want = smp.closed_minutes(smp.minute_fold(every), last - DELAY)
    got = spark.read.schema(minutes.schema).parquet(f"{tmp_path}/out")
    assert folded(got) == folded(want)


def test_first_sight_is_quiet_until_the_delay_has_passed(spark, tmp_path):
    gap = timedelta(hours=1)
    files = [
        [sample(1, START, 1, "tcp_sendmsg", 1), sample(2, START + timedelta(seconds=5), 1, "tcp_sendmsg", 1)],
        [sample(3, START + timedelta(seconds=30), 1, "tcp_sendmsg", 1), sample(4, START + timedelta(seconds=31), 2, "tcp_sendmsg", 1)],
        [sample(5, START + gap, 3, "tcp_sendmsg", 1)],
        [sample(6, START + gap, 3, "tcp_sendmsg", 1)],
        [sample(7, START + gap, 1, "tcp_sendmsg", 1)],
    ]
    land(spark, f"{tmp_path}/in", files)
    stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=1)
    sight = live.stream_first_sight(stream, DELAY)
    run(sight.writeStream.format("parquet").option("path", f"{tmp_path}/out"), f"{tmp_path}/state")
    got = spark.read.schema(sight.schema).parquet(f"{tmp_path}/out").groupBy("tgid").count()
    assert rows_of(got) == [(1, 2), (2, 1), (3, 1)]


def lookups(spark, samples=()):
    return feeds(spark, samples=samples, snapshots=[snapshot(t, START, cmdline=f"app\0{t}x") for t in (1, 2)],
                 meta=[("h", 3, 1000, "7", "rsync\0", START)])


def per_identity(store, tier="minute"):
    names = store.identities().select(F.col("id").alias("identity_id"), "normalized_cmdline")
    rows = store.scan(tier).join(names, "identity_id")
    return rows_of(rows.groupBy("normalized_cmdline").agg(F.sum("ingress_bytes"), F.sum("egress_bytes")))


def totals(samples, names=("<unresolved>", "app 1x", "app 2x", "<unresolved:rsync>"), before=None):
    want = {}
    for _, ts, _, tgid, hook, ret, *_ in samples:
        if ret > 0 and (before is None or ts < before):
            want.setdefault(names[tgid], [0, 0])[hook == "tcp_sendmsg"] += ret
    return sorted(((k, *v) for k, v in want.items()), key=repr)


def test_stream_to_store_survives_a_replay_and_takes_late_samples(spark, tmp_path, root):
    files = traffic(2, 20, per_minute=8)
    everything = [r for f in files for r in f]
    late = sample(999, START + timedelta(minutes=1), 1, "tcp_sendmsg", 5000)
    files.append([late])
    land(spark, f"{tmp_path}/in", files)
    store = Store(spark, root)
    known = lookups(spark)

    def start(checkpoint):
        stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=2)
        run(live.ingest_stream(store, stream, lambda: known, DELAY, "live", Settings()), checkpoint)

    start(f"{tmp_path}/state")
    closed = store.watermark("minute")
    assert closed is not None
    assert per_identity(store) == totals(everything, before=closed)
    # a lost checkpoint reads everything again
    start(f"{tmp_path}/state-2")
    assert per_identity(store) == totals(everything, before=closed)

    now = START + timedelta(hours=3)
    store.maintain(now, Settings(), complete_through=closed)
    full = lookups(spark, everything + [late])
    reconcile(spark, store, full, "late-1", START, START + timedelta(hours=1), Settings())
    store.maintain(now + timedelta(hours=3), Settings())
    for tier in ("minute", "hour"):
        assert per_identity(store, tier) == totals(everything + [late]), tier


def test_minute_in_which_a_number_changes_hands_is_split(spark, tmp_path, root):
    """Within one minute and over two micro-batches; number 1 passes on at 1:30, number 2 stays with its process."""
    at = lambda seconds: START + timedelta(seconds=seconds)
    land(spark, f"{tmp_path}/in", [
        [sample(1, at(61), 1, "tcp_sendmsg", 1), sample(2, at(89.9), 1, "tcp_sendmsg", 10), sample(3, at(89.9), 2, "tcp_sendmsg", 7)],
        [sample(4, at(90), 1, "tcp_sendmsg", 100), sample(5, at(119), 1, "udp_recvmsg", 1000), sample(6, at(100), 2, "tcp_sendmsg", 7)],
        [sample(7, at(121), 1, "tcp_sendmsg", 10000)],
        [sample(8, at(900), 2, "tcp_sendmsg", 5)],
    ])
    known = feeds(spark, samples=(), snapshots=[
        snapshot(1, START, cmdline="first app"), snapshot(1, at(90), cmdline="second app"), snapshot(2, START, cmdline="other app")])
    store = Store(spark, root)
    stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=1)
    run(live.ingest_stream(store, stream, lambda: known, DELAY, "live", Settings()), f"{tmp_path}/state")
    assert per_identity(store) == [("first app", 0, 11), ("other app", 0, 14), ("second app", 1000, 10100)]
    rows = store.scan("minute").groupBy("bucket", "identity_id", "scope").count()
    assert rows.where("count > 1").isEmpty()


def test_watch_emits_changed_minutes_per_trigger(spark, tmp_path):
    files = traffic(3, 10)
    land(spark, f"{tmp_path}/in", files)
    emitted = {}

    def identify(folds, stage):
        facts = folds.groupBy("bucket", F.col("tgid").alias("identity_id"), "scope").agg(
            F.sum("ingress_bytes").alias("ingress_bytes"), F.sum("egress_bytes").alias("egress_bytes"))
        people = facts.select(F.col("identity_id").alias("id"), F.lit("h").alias("host")).distinct()
        return facts, people

    def emit(ranked, number):
        emitted[number] = ranked.select(
            F.unix_seconds("bucket").alias("b"), "rank", "group_key", "ingress_bytes", "egress_bytes").collect()

    stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=1)
    run(live.stream_watch(stream, identify, emit, DELAY, limit=2), f"{tmp_path}/state")
    assert len([rows for rows in emitted.values() if rows]) == 2
    for rows in emitted.values():
        per_minute = {}
        for r in rows:
            per_minute.setdefault(r.b, []).append((r["rank"], r.ingress_bytes + r.egress_bytes))
        for ranks in per_minute.values():
            assert [k for k, _ in sorted(ranks)] == [1, 2]
            assert sorted(ranks)[0][1] >= sorted(ranks)[1][1]


def test_watch_shows_a_caller_only_what_is_theirs(spark, tmp_path, root):
    land(spark, f"{tmp_path}/in", [[
        sample(1, START, 1, "tcp_sendmsg", 5), sample(2, START, 3, "tcp_sendmsg", 9), sample(3, START, 0, "tcp_sendmsg", 7)]])
    known = lookups(spark)
    seen = {}
    for caller in (1000, 0):
        def emit(ranked, number):
            seen.setdefault(caller, []).extend(ranked.select("rank", "host", "egress_bytes").collect())

        stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True)
        reader = Reader(Store(spark, root), Settings(), caller, caller_host="h")
        run(reader.watch(stream, lambda: known, emit, DELAY), f"{tmp_path}/state-{caller}")
    assert sorted(map(tuple, seen[1000])) == [(1, "h", 9), (2, "h", 5)]
    assert sorted(map(tuple, seen[0])) == [(1, "h", 9), (2, "h", 7), (3, "h", 5)]


def test_watch_ranks_whole_minutes_and_closed_ones_once(spark, tmp_path):
    minute = START + timedelta(minutes=1)
    files = [
        [sample(1, minute, 1, "tcp_sendmsg", 100), sample(2, minute, 2, "tcp_sendmsg", 50)],
        [sample(3, minute + timedelta(seconds=9), 2, "tcp_sendmsg", 5)],
        [sample(4, minute + timedelta(minutes=1), 2, "tcp_sendmsg", 7)],
        [sample(5, minute + timedelta(minutes=30), 1, "tcp_sendmsg", 1)],
        [sample(6, minute + timedelta(minutes=31), 1, "tcp_sendmsg", 1)],
    ]
    land(spark, f"{tmp_path}/in", files)

    def identify(folds, stage):
        facts = folds.groupBy("bucket", F.col("tgid").alias("identity_id"), "scope").agg(
            F.sum("ingress_bytes").alias("ingress_bytes"), F.sum("egress_bytes").alias("egress_bytes"))
        return facts, facts.select(F.col("identity_id").alias("id"), F.lit("h").alias("host")).distinct()

    def watched(closed):
        emitted = []

        def emit(ranked, number):
            rows = ranked.select(F.unix_seconds("bucket").alias("b"), "rank", "group_key", "egress_bytes").collect()
            emitted.append(sorted(((r.b - int(minute.timestamp())) // 60, r["rank"], r.group_key, r.egress_bytes) for r in rows))

        stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=1)
        run(live.stream_watch(stream, identify, emit, DELAY, closed=closed), f"{tmp_path}/state-{closed}")
        return [rows for rows in emitted if rows]

    first = [(0, 1, "1", 100), (0, 2, "2", 50)]
    second = [(0, 1, "1", 100), (0, 2, "2", 55)]
    assert watched(False) == [first, second, [(1, 1, "2", 7)], [(30, 1, "1", 1)], [(31, 1, "1", 1)]]
    assert [r for rows in watched(True) for r in rows] == second + [(1, 1, "2", 7)]


def test_new_checkpoint_with_other_batches_adds_only_what_is_missing(spark, tmp_path, root):
    store, known = Store(spark, root), lookups(spark)
    first = [[sample(1, START, 1, "tcp_sendmsg", 1)], [sample(2, START + timedelta(hours=1), 1, "tcp_sendmsg", 5)]]
    land(spark, f"{tmp_path}/in", first)

    def start(checkpoint, per_trigger):
        stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=per_trigger)
        run(live.ingest_stream(store, stream, lambda: known, DELAY, "live", Settings()), checkpoint)

    start(f"{tmp_path}/a", 1)
    assert per_identity(store) == [("app 1x", 0, 1)]
    land(spark, f"{tmp_path}/more", [[sample(3, START + timedelta(minutes=2), 2, "tcp_sendmsg", 101)]])
    spark.read.schema(first_schema()).parquet(f"{tmp_path}/more").write.mode("append").parquet(f"{tmp_path}/in")
    start(f"{tmp_path}/b", 100)
    assert per_identity(store) == [("app 1x", 0, 1), ("app 2x", 0, 101)]
    start(f"{tmp_path}/b", 100)
    assert sum(r[2] for r in per_identity(store)) == 102


def first_schema():
    from bytewake import schemas

    return schemas.SOCKET_SAMPLE


def test_micro_batches_are_worked_on_with_adaptive_plans(spark, tmp_path):
    land(spark, f"{tmp_path}/in", traffic(5, 10))
    stream = landing.scan_samples(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger=1)
    seen = []

    def identify(folds, stage):
        seen.append((folds.sparkSession.conf.get("spark.sql.adaptive.enabled"), folds.count()))
        facts = folds.select("bucket", F.col("tgid").alias("identity_id"), "scope", "ingress_bytes", "egress_bytes")
        return facts, schemas.empty(spark, schemas.IDENTITY)

    run(live.stream_watch(stream, identify, lambda ranked, number: ranked.collect(), DELAY), f"{tmp_path}/state")
    assert {adaptive for adaptive, _ in seen} == {"true"} and sum(n for _, n in seen) > 0


def test_lookup_feeds_are_narrowed_before_they_are_cleaned(spark, tmp_path):
    from bytewake.plans.attribution import narrowed
    from bytewake.staging import staging

    every = feeds(spark, snapshots=[snapshot(1, START), snapshot(2, START)])
    folds = smp.minute_fold(spark.createDataFrame([sample(1, START, 2, "tcp_sendmsg", 1)], schemas.SOCKET_SAMPLE))
    with staging(spark, "narrow") as stage:
        near = narrowed(every, folds, stage)
        assert rows_of(near.snapshots, "tgid") == [(2,)]
        assert near.snapshots.inputFiles() and not every.snapshots.inputFiles()


def test_a_micro_batch_of_a_large_table_is_read_by_many_tasks_but_ends_at_its_border(spark, tmp_path):
    from checks import fixtures as fx

    rows = [(i, START + timedelta(hours=i), i % 3, "click", 1.0, '{"k": 1}') for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(24).write.parquet(f"{tmp_path}/events.parquet")
    # the last border is passed by a single sample, so most of its files are empty
    stream = fx.sample_stream(spark, str(tmp_path), "2024-01-01 10:00:00", "2024-01-02 15:00:00")
    batches = []

    def keep(df, number):
        rows = df.select("sample_id", F.spark_partition_id().alias("task")).collect()
        batches.append((len({r.task for r in rows}), sorted(r.sample_id for r in rows)))

    run(stream.writeStream.foreachBatch(keep), f"{tmp_path}/state")
    assert [ids for _, ids in batches] == [list(range(10)), list(range(10, 39)), [39]]
    assert batches[0][0] > 1 and batches[1][0] > 1
