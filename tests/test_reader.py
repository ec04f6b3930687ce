from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from bytewake import schemas
from bytewake.config import Settings
from bytewake.plans.attribution import ingest
from bytewake.plans.reader import Asked, Reader
from bytewake.sources.store import IDENTITY_TABLE, Store
from tests.conftest import rows_of, utc
from tests.test_identity import feeds, snapshot
from tests.test_samples import sample

NOW = utc(2024, 1, 3, 12)
SETTINGS = Settings(tz="America/New_York")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = Store(spark, str(tmp_path_factory.mktemp("reader")))
    at = utc(2024, 1, 2, 4, 59, 30)
    world = feeds(
        spark,
        snapshots=[
            snapshot(1, at), snapshot(2, at, exe="/usr/bin/curl", cwd="/home/y", status="Uid:\t1001\n"),
        ],
        passwd=[("h", 1, 1000, "ann")],
        markers=[("h", "/home/x", ".git")],
        samples=[
            sample(1, at, 1, "tcp_sendmsg", 10),
            sample(2, at + timedelta(minutes=1), 1, "tcp_sendmsg", 5),
            sample(3, at, 2, "udp_recvmsg", 100),
            sample(4, at + timedelta(hours=20), 3, "udp_recvmsg", 7),
        ],
    )
    ingest(spark, root, world, "a", SETTINGS)
    root.maintain(NOW, SETTINGS)
    return root


def test_root_sees_everyone_in_every_tier(store):
    for tier in ("minute", "hour", "day"):
        top = Reader(store, SETTINGS, 0).top(Asked(NOW, since=timedelta(hours=60), tier=tier), by="exe")
        assert rows_of(top, "group_key", "ingress_bytes", "egress_bytes") == [
            ("/usr/bin/curl", 100, 0), ("/usr/bin/node", 0, 15), ("<unresolved>", 7, 0)], tier


def test_user_sees_own_traffic_only(store):
    asked = Asked(NOW, since=timedelta(hours=48))
    mine = Reader(store, SETTINGS, 1000, caller_host="h")
    assert rows_of(mine.top(asked), "label", "egress_bytes") == [("/usr/bin/node", 15)]
    assert rows_of(mine.list(), "exe") == [("/usr/bin/node",)]
    other = Reader(store, SETTINGS, 0, uid=1001)
    assert rows_of(other.top(asked), "label", "ingress_bytes") == [("/usr/bin/curl", 100)]
    ids = dict(rows_of(Reader(store, SETTINGS, 0).identities(), "exe", "id"))
    assert mine.show(ids["/usr/bin/node"]).username == "ann"
    with pytest.raises(LookupError):
        mine.show(ids["/usr/bin/curl"])
    assert mine.series(ids["/usr/bin/curl"], asked).counters.count() == 0


def test_filters_and_presets(store):
    root = Reader(store, SETTINGS, 0)
    month = Asked(NOW, preset="this-month")
    assert root.window(month)[0] == "month"
    day = Asked(NOW, start=utc(2024, 1, 1, 5), end=utc(2024, 1, 2, 5), tier="day")
    # local new year's day ends in the middle of the traffic
    assert rows_of(root.top(day, by="project", user="ann"), "group_key", "egress_bytes") == [("/home/x", 10)]
    assert rows_of(root.top(day, by="project", project="<none>"), "group_key", "ingress_bytes") == [("<none>", 100)]
    assert rows_of(root.unresolved_share(Asked(NOW, since=timedelta(hours=60), tier="hour")), "group_key",
                   "resolved_ingress_bytes", "unresolved_ingress_bytes") == [
        ("1000", 0, 0), ("1001", 100, 0), ("4294967295", 0, 7)]


def test_series_refers_to_its_identity(store):
    root = Reader(store, SETTINGS, 0)
    node = root.list("bin/node").select("id").first().id
    answer = root.series(node, Asked(NOW, since=timedelta(hours=48)))
    start = int(utc(2024, 1, 2, 4).timestamp() * 1000)
    assert rows_of(answer.counters) == [(node, start, "external", 0, 10), (node, start + 3600000, "external", 0, 5)]
    assert rows_of(answer.identities, "id") == [(node,)]
    assert answer.identities.where(F.col("comm") == "node").count() == 1


def test_windows_lose_no_bytes(spark, tmp_path):
    from bytewake.config import Settings
    from tests.test_tiers import facts

    store, settings = Store(spark, str(tmp_path)), Settings()
    now = utc(2024, 3, 20, 21, 30)
    store.append("minute", facts(spark, *[(now - timedelta(days=d, minutes=30), 1, "external", 1, 0) for d in range(1, 100)]), "a")
    store.stage_identities(spark.createDataFrame(
        [(1, "h", 1000, "u", "e", "p", "n", "c", "r", None, now, now)], schemas.IDENTITY), "a")
    store.commit_batches([(IDENTITY_TABLE, "a")])
    store.maintain(now, settings)
    reader = Reader(store, settings, 0)
    for days in (32, 60):
        asked = Asked(now, since=timedelta(days=days, hours=1))
        answer = reader.top_answer(asked)
        assert [(r["ingress_bytes"], r["label"]) for r in answer.counters.collect()] == [(days, "e")], days
        assert [r["id"] for r in answer.identities.collect()] == [1]
        assert answer.window[0] <= now - timedelta(days=days, hours=1) < answer.window[0] + timedelta(hours=1)
    history = reader.series(1, asked).counters
    assert history.agg(F.sum("ingress_bytes")).first()[0] == 60
    # past what hours hold: the edge is a whole day, and the answer says so
    old = Asked(now, since=timedelta(days=95))
    start, _ = reader.effective(old)
    assert start == utc(2023, 12, 16)


def test_pieces_tile_the_window():
    from bytewake.config import Settings
    from bytewake.operators import verbs

    tz = "America/New_York"
    rolled = {"hour": utc(2024, 3, 20, 21, 29), "day": utc(2024, 3, 20, 21), "month": utc(2024, 3, 20, 4)}
    for start, end in [(utc(2023, 11, 2, 3, 7, 9), utc(2024, 3, 20, 21, 30)), (utc(2024, 3, 10, 6, 30), utc(2024, 3, 11, 4)), (utc(2024, 3, 20, 21), utc(2024, 3, 20, 21, 5))]:
        for tier in ("minute", "hour", "day", "month"):
            pieces = verbs.window_pieces((start, end), tier, Settings(tz=tz), rolled, {})
            assert pieces[0][1] == start.replace(second=0) and pieces[-1][2] == end
            assert all(a[2] == b[1] for a, b in zip(pieces, pieces[1:]))
            assert all(a < b for _, a, b in pieces)
