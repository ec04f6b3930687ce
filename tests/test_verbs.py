from datetime import timedelta

import pytest

from bytewake import schemas
from bytewake.config import Settings
from bytewake.operators import verbs
from bytewake.sources import landing
from tests.conftest import rows_of, utc
from tests.test_tiers import facts, stamped

NEW_YORK = "America/New_York"
NOW = utc(2024, 3, 10, 12)
DAY = utc(2024, 3, 1)


def identity(spark):
    return spark.createDataFrame(
        [
            (1, "h", 1000, "u", "/bin/node", "/p/a", "x", "node", "x", "ann", DAY, DAY),
            (2, "h", 1000, "u", "/bin/node", "/p/b", "y", "node", "y", "ann", DAY, DAY),
            (3, "h", 1001, "u", "/bin/100%_x", "<none>", "z", None, "z", None, DAY, DAY),
            (4, "g", 1000, "u", "<unresolved>", "<unresolved>", "<unresolved:c>", "c", "", "bob", DAY, DAY),
        ],
        schemas.IDENTITY,
    )


def traffic(spark):
    return facts(
        spark,
        (DAY, 1, "external", 10, 1), (DAY + timedelta(days=1), 1, "loopback", 500, 0),
        (DAY, 2, "external", 0, 11), (DAY, 3, "external", 5, 5), (DAY, 4, "external", 1, 2),
    )


def test_top_ranks_by_both_directions_and_breaks_ties_by_key(spark):
    got = verbs.top(traffic(spark), identity(spark)).collect()
    assert [(r.group_key, r.ingress_bytes, r.egress_bytes) for r in got] == [
        ("1", 10, 1), ("2", 0, 11), ("3", 5, 5), ("4", 1, 2)]
    assert verbs.top(traffic(spark), identity(spark)).columns == [
        "host", "group_key", "label", "ingress_bytes", "egress_bytes"]


def test_top_by_one_direction_shows_only_that(spark):
    got = verbs.top(traffic(spark), identity(spark), direction="ingress", limit=2)
    assert got.columns == ["host", "group_key", "label", "ingress_bytes"]
    assert [r.group_key for r in got.collect()] == ["1", "3"]


def test_groups_do_not_mix_hosts(spark):
    by_user = verbs.top(traffic(spark), identity(spark), by="user", scope="all")
    assert rows_of(by_user) == [
        ("g", "1000", "bob", 1, 2), ("h", "1000", "ann", 510, 12), ("h", "1001", None, 5, 5)]
    by_exe = verbs.top(traffic(spark), identity(spark), by="exe")
    assert rows_of(by_exe, "host", "group_key", "ingress_bytes")[0] == ("g", "<unresolved>", 1)


def test_limit_zero_means_twenty(spark):
    many = facts(spark, *[(DAY, i, "external", i, 0) for i in range(1, 40)])
    people = spark.createDataFrame(
        [(i, "h", 1, "u", f"/bin/{i}", "<none>", "x", None, "", None, DAY, DAY) for i in range(1, 40)], schemas.IDENTITY)
    assert verbs.top(many, people).count() == 20
    assert verbs.top(many, people, limit=100).count() == 39


def test_default_scope_hides_loopback(spark):
    assert verbs.in_scope(traffic(spark)).count() == 4
    assert verbs.in_scope(traffic(spark), "loopback").count() == 1
    assert verbs.in_scope(traffic(spark), "all").count() == 5


def test_search_is_literal(spark):
    people = identity(spark)
    assert rows_of(verbs.list_identities(people, "%_"), "id") == [(3,)]
    assert rows_of(verbs.list_identities(people, "node"), "id") == [(1,), (2,)]
    assert verbs.list_identities(people).count() == 4
    assert verbs.list_identities(people, "/p/").count() == 2


def test_unknown_identity_is_not_found(spark):
    assert verbs.require_identity(identity(spark), 3).exe == "/bin/100%_x"
    with pytest.raises(LookupError):
        verbs.require_identity(identity(spark), 99)


def test_visibility(spark):
    people = identity(spark)
    ids = lambda **who: [i for i, in rows_of(verbs.visible(people, **who), "id")]
    assert ids(caller_uid=0) == [1, 2, 3, 4]
    assert ids(caller_uid=0, uid=1001) == [3]
    assert ids(caller_uid=1001, caller_host="h") == [3]
    assert ids(caller_uid=1001, caller_host="elsewhere") == []
    assert ids(caller_uid=1001, uid=1000, caller_host="h") == [3]
    assert ids(caller_uid=1001, is_admin=True, uid=1000) == [1, 2, 4]
    # root stays root, whoever else is an admin
    assert ids(caller_uid=0, settings=Settings(admin_uids=(1000,))) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        ids(caller_uid=1001)


def test_series_obeys_window_scope_and_visibility(spark):
    window = (DAY, DAY + timedelta(days=2))
    people = identity(spark)
    assert [r[0] for r in stamped(verbs.series(traffic(spark), people, 1, window, "all"))] == [
        "2024-03-01 00:00", "2024-03-02 00:00"]
    assert verbs.series(traffic(spark), people, 1, window).count() == 1
    assert verbs.series(traffic(spark), people, 1, (DAY, DAY), "all").count() == 0
    assert verbs.series(traffic(spark), verbs.visible(people, 1001, caller_host="h"), 1, window, "all").count() == 0


def test_windows_begin_at_local_midnight():
    # clocks went forward that morning
    assert verbs.time_window(NOW, NEW_YORK, preset="today") == (utc(2024, 3, 10, 5), NOW)
    assert verbs.time_window(NOW, NEW_YORK, preset="this-month") == (utc(2024, 3, 1, 5), NOW)
    assert verbs.time_window(NOW, NEW_YORK, since=timedelta(hours=24)) == (utc(2024, 3, 9, 12), NOW)
    with pytest.raises(ValueError):
        verbs.time_window(NOW, NEW_YORK)


@pytest.mark.parametrize(
    "hours, ago, tier",
    [(6, 0, "minute"), (7, 0, "hour"), (48, 0, "hour"), (49, 0, "day"), (24 * 31, 0, "day"), (24 * 32, 0, "month"),
     (1, 72, "hour"), (1, 24 * 100, "day"), (1, 24 * 800, "month")],
)
def test_tier_follows_span_and_retention(hours, ago, tier):
    end = NOW - timedelta(hours=ago)
    assert verbs.pick_tier((end - timedelta(hours=hours), end), NOW, Settings()) == tier


def test_tier_can_be_forced():
    window = (NOW - timedelta(hours=1), NOW)
    assert verbs.pick_tier(window, NOW, Settings(), tier="day") == "day"
    assert verbs.pick_tier(window, NOW, Settings(), preset="this-month") == "month"
    with pytest.raises(ValueError):
        verbs.pick_tier(window, NOW, Settings(), tier="week")


def test_results_refer_to_their_identities(spark):
    counters = verbs.counter_rows(verbs.in_scope(traffic(spark), "loopback"))
    assert rows_of(counters) == [(1, 1709337600000, "loopback", 500, 0)]
    assert rows_of(verbs.referenced_identities(counters, identity(spark)), "id") == [(1,)]


def test_unresolved_share(spark):
    assert rows_of(verbs.unresolved_share(traffic(spark), identity(spark))) == [
        ("g", "1000", 0, 0, 1, 2), ("h", "1000", 10, 12, 0, 0), ("h", "1001", 5, 5, 0, 0)]


def test_json_round_trip_keeps_nulls(spark, tmp_path):
    path = str(tmp_path / "out")
    landing.json_sink(identity(spark).select("id", "comm"), path)
    assert '{"id":3,"comm":null}' in [r.value for r in spark.read.text(path).collect()]
