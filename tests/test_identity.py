import random
from datetime import timedelta

from pyspark.sql import functions as F

from bytewake import schemas
from bytewake.config import NATURAL_KEY, UNKNOWN_UID
from bytewake.operators import identity as ids
from bytewake.operators import samples as smp
from bytewake.plans.attribution import Feeds, lifetime_folds, sightings
from bytewake.staging import stage_in
from tests.conftest import rows_of, utc
from tests.test_samples import address

DAY = utc(2024, 1, 1)


def snapshot(tgid, seen_at, exe="/usr/bin/node", cwd="/home/x/proj", cmdline="cargo\0watch\0lint", status="Uid:\t1000\n", host="h"):
    return (host, tgid, seen_at, exe, cwd, "node\n", cmdline, status, "0::/user.slice\n")


def feeds(spark, snapshots=(), meta=(), passwd=(), markers=(), samples=()):
    make = spark.createDataFrame
    return Feeds(
        samples=make(list(samples), schemas.SOCKET_SAMPLE),
        snapshots=make(list(snapshots), schemas.PROC_SNAPSHOT),
        meta=make(list(meta), schemas.PID_META),
        passwd=make(list(passwd), schemas.PASSWD),
        markers=make(list(markers), schemas.PROJECT_MARKER),
    )


def sighting(at, key="cargo watch lint", raw="cargo watch lint", username="x", comm="node", seq=0, host="h"):
    return (host, 1000, "/user.slice", "/usr/bin/node", "/p", key, comm, raw, username, at, at, seq)


SIGHTING = "host string, uid long, unit_or_cgroup string, exe string, project_root string, " \
    "normalized_cmdline string, comm string, raw_cmdline string, username string, " \
    "first_seen timestamp, last_seen timestamp, seq long"


def upsert(spark, dimension, *seen):
    return ids.identity_upsert(spark.createDataFrame(list(seen), SIGHTING), dimension, stage_in(spark, "t"))


def test_same_key_keeps_id_and_takes_newest_display(spark):
    one = upsert(spark, schemas.empty(spark, schemas.IDENTITY), sighting(DAY, raw="cargo -j 4"))
    two = upsert(spark, one, sighting(DAY + timedelta(days=1), raw="cargo -j 16"))
    assert rows_of(two, "id", "raw_cmdline") == [(1, "cargo -j 16")]
    three = upsert(spark, two, sighting(DAY, key="cargo watch docs"))
    assert rows_of(three, "id", "normalized_cmdline") == [(1, "cargo watch lint"), (2, "cargo watch docs")]


def test_newer_null_username_replaces_a_name(spark):
    one = upsert(spark, schemas.empty(spark, schemas.IDENTITY), sighting(DAY))
    two = upsert(spark, one, sighting(DAY + timedelta(days=1), username=None, comm=None))
    assert rows_of(two, "id", "username", "comm") == [(1, None, None)]
    span = two.select(F.unix_seconds("last_seen") - F.unix_seconds("first_seen")).first()[0]
    assert span == 86400


def test_older_sighting_does_not_overwrite(spark):
    one = upsert(spark, schemas.empty(spark, schemas.IDENTITY), sighting(DAY + timedelta(days=1), raw="new"))
    two = upsert(spark, one, sighting(DAY, raw="old"))
    assert rows_of(two, "raw_cmdline") == [("new",)]
    assert two.select(F.unix_seconds("last_seen") - F.unix_seconds("first_seen")).first()[0] == 86400


def test_order_of_one_instant_is_seq(spark):
    seen = [sighting(DAY, raw=f"r{i}", seq=i) for i in (3, 9, 5)]
    assert rows_of(upsert(spark, schemas.empty(spark, schemas.IDENTITY), *seen), "raw_cmdline") == [("r9",)]


def test_ids_are_dense_unique_and_above_the_old_ones(spark):
    seen = [sighting(DAY + timedelta(days=i % 3), key=f"k{i}") for i in range(500)]
    one = upsert(spark, schemas.empty(spark, schemas.IDENTITY), *seen)
    assert sorted(r.id for r in one.collect()) == list(range(1, 501))
    by_day = {}
    for r in one.collect():
        by_day.setdefault(r.first_seen.date(), []).append(r.id)
    spans = [(min(v), max(v)) for _, v in sorted(by_day.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    before = {r.normalized_cmdline: r.id for r in one.collect()}
    two = upsert(spark, one, *[sighting(DAY, key=f"k{i}") for i in range(400, 700)])
    after = {r.normalized_cmdline: r.id for r in two.collect()}
    assert all(after[k] == i for k, i in before.items())
    assert sorted(after[f"k{i}"] for i in range(500, 700)) == list(range(501, 701))


def test_deepest_marker_wins_and_other_files_do_not_count(spark):
    f = feeds(spark, markers=[
        ("h", "/", ".git"), ("h", "/base", "package.json"), ("h", "/base/repo", "Cargo.toml"),
        ("h", "/base/repo/sub", "README.md"), ("g", "/base/repo/sub", ".git"), ("k", "/base/repo/su", ".git"),
    ])
    dirs = spark.createDataFrame(
        [("h", "/base/repo/sub/dir"), ("h", "/base/repo"), ("h", "/base/other"), ("h", "/"),
         ("g", "/base/repo/sub/dir"), ("k", "/base/repo/sub"), ("none", "/base/repo")], "host string, cwd string")
    assert rows_of(ids.with_project_root(dirs, f.markers), "host", "cwd", "project_root") == [
        ("g", "/base/repo/sub/dir", "/base/repo/sub"),
        ("h", "/", "/"),
        ("h", "/base/other", "/base"),
        ("h", "/base/repo", "/base/repo"),
        ("h", "/base/repo/sub/dir", "/base/repo"),
        ("k", "/base/repo/sub", "<none>"),
        ("none", "/base/repo", "<none>"),
    ]


def test_project_root_against_brute_force(spark):
    rng = random.Random(5)
    path = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))
    dirs = {("h", path().rstrip("/") or "/") for _ in range(400)}
    marked = {path().rstrip("/") or "/" for _ in range(25)}
    f = feeds(spark, markers=[("h", d, ".git") for d in marked])
    found = {(r.host, r.cwd): r.project_root for r in ids.with_project_root(
        spark.createDataFrame(list(dirs), "host string, cwd string"), f.markers).collect()}
    for host, cwd in dirs:
        walk = cwd
        while walk not in marked and walk != "/":
            walk = walk.rsplit("/", 1)[0] or "/"
        assert found[host, cwd] == (walk if walk in marked else "<none>")


def test_first_passwd_line_wins_and_malformed_lines_are_skipped(spark):
    passwd = spark.createDataFrame(
        [("h", 3, 7, "later"), ("h", 2, 7, "first"), ("h", 1, None, "bad"), ("h", 0, 7, None), ("g", 0, 7, "other")],
        schemas.PASSWD)
    assert rows_of(ids.usernames(passwd)) == [("g", 7, "other"), ("h", 7, "first")]


def test_metadata_record(spark):
    f = feeds(spark, meta=[("h", 1, 1000, "42", "rsync\0\0\0\0", DAY)])
    row = ids.meta_records(f.meta, f.passwd).first()
    assert (row.exe, row.project_root, row.unit_or_cgroup, row.normalized_cmdline, row.comm, row.raw_cmdline) == (
        "<unresolved>", "<unresolved>", "cgroup-id:42", "<unresolved:rsync>", "rsync", "")
    assert row.username is None


def test_every_process_resolves(spark):
    f = feeds(
        spark,
        snapshots=[snapshot(1, DAY), snapshot(4, DAY, status=None)],
        meta=[("h", i, 1000, "42", "rsync\0", DAY) for i in (1, 2, 4)],
    )
    lives = spark.createDataFrame(
        [("h", 1, DAY), ("h", 2, None), ("h", 3, None), ("h", 4, DAY)], "host string, tgid long, gen_start timestamp")
    found = ids.resolve_chain(
        lives, ids.snapshot_records(f.snapshots, f.passwd, f.markers), ids.meta_records(f.meta, f.passwd))
    assert rows_of(found.select("tgid", "source", "record.uid", "record.exe")) == [
        (1, "snapshot", 1000, "/usr/bin/node"),
        (2, "metadata", 1000, "<unresolved>"),
        (3, "none", UNKNOWN_UID, "<unresolved>"),
        (4, "metadata", 1000, "<unresolved>"),
    ]


def test_repeated_lookup_rows_do_not_multiply_processes(spark):
    f = feeds(
        spark,
        snapshots=[snapshot(1, DAY), snapshot(1, DAY, exe="/usr/bin/other"), snapshot(1, DAY, status=None)],
        meta=[("h", 2, 1000, "42", c, DAY) for c in ("rsync\0", "wget\0")],
    )
    lives = spark.createDataFrame([("h", 1, DAY), ("h", 2, None)], "host string, tgid long, gen_start timestamp")
    found = ids.resolve_chain(
        lives, ids.snapshot_records(f.snapshots, f.passwd, f.markers), ids.meta_records(f.meta, f.passwd))
    assert rows_of(found, "tgid", "source") == [(1, "snapshot"), (2, "metadata")]


def brute_start(starts, ts):
    known = sorted(starts)
    past = [s for s in known if s <= ts]
    return past[-1] if past else (known[0] if known else None)


def random_lives(seed, hot):
    """Starts and samples that crowd into a few minutes, many at equal instants."""
    rng = random.Random(seed)
    moment = lambda: DAY + timedelta(microseconds=rng.choice([0, 1, 30_000_000, rng.randrange(400_000_000)]))
    starts = {("h", t): {moment() for _ in range(rng.randint(0, 4))} for t in range(6)}
    starts["h", 0] = {moment() for _ in range(60)}
    samples = [
        (i, moment(), "h", 0 if rng.random() < hot else rng.randrange(7), rng.choice(["tcp_sendmsg", "udp_recvmsg"]),
         rng.randint(-3, 50), 2, address(rng.choice(["127.0.0.1", "10.0.0.1"])), address("10.0.0.2"))
        for i in range(900)
    ]
    return starts, samples


def test_lifetimes_against_brute_force(spark):
    for seed in (1, 2):
        starts, samples = random_lives(seed, hot=0.4)
        f = feeds(spark, snapshots=[snapshot(t, s) for (_, t), all_ in starts.items() for s in all_], samples=samples)
        marks = ids.lifetime_starts(f.snapshots)
        for width in (1, 3600):
            placed = ids.tgid_lifetime(f.samples, marks, "ts", width)
            got = {r.sample_id: r.g for r in placed.select("sample_id", F.unix_micros("gen_start").alias("g")).collect()}
            assert len(got) == len(samples)
            for s in samples:
                want = brute_start(starts.get(("h", s[3]), ()), s[1])
                assert got[s[0]] == (None if want is None else int(want.timestamp() * 1e6 + 0.5))


def test_minute_folds_follow_lifetimes_inside_a_minute(spark):
    for seed in (3, 4):
        starts, samples = random_lives(seed, hot=0.4)
        f = feeds(spark, snapshots=[snapshot(t, s) for (_, t), all_ in starts.items() for s in all_], samples=samples)
        want = {}
        for _, ts, host, tgid, hook, ret, _, daddr, _ in samples:
            if ret <= 0:
                continue
            born = brute_start(starts.get((host, tgid), ()), ts)
            key = (tgid, None if born is None else int(born.timestamp() * 1e6 + 0.5), int(ts.timestamp()) // 60,
                   "loopback" if daddr[0] == 127 else "external")
            pair = want.setdefault(key, [0, 0])
            pair[hook == "tcp_sendmsg"] += ret
        folds = lifetime_folds(f, stage_in(spark, "t"))
        placed = ids.minute_lifetime(smp.minute_fold(f.samples), ids.lifetime_starts(f.snapshots))
        assert placed.where("torn").count() > 0
        got = {
            (r.tgid, r.g, r.m, r.scope): [r.ingress_bytes, r.egress_bytes]
            for r in folds.select(
                "*", F.unix_micros("gen_start").alias("g"), F.expr("unix_seconds(bucket) div 60").alias("m")).collect()
        }
        assert got == want


def test_sightings_cover_every_process_with_traffic(spark):
    starts, samples = random_lives(7, hot=0.2)
    f = feeds(spark, snapshots=[snapshot(t, s) for (_, t), all_ in starts.items() for s in all_], samples=samples)
    folds = lifetime_folds(f, stage_in(spark, "t"))
    seen = sightings(folds, f)
    assert seen.count() == folds.select("host", "tgid", "gen_start").distinct().count()
    assert {r.source for r in seen.collect()} == {"snapshot", "none"}
    assert all(r[c] is not None for r in seen.collect() for c in NATURAL_KEY)
