import socket

import pytest
from pyspark.sql import functions as F

from bytewake.functions.network import direction_of_hook, scope_of
from bytewake.operators import samples as smp
from bytewake.schemas import SOCKET_SAMPLE
from tests.conftest import rows_of, utc

V4, V6 = 2, 10


def address(text):
    if text is None:
        return None
    return bytearray(socket.inet_pton(socket.AF_INET6 if ":" in text else socket.AF_INET, text))


@pytest.mark.parametrize(
    "family, dest, source, scope",
    [
        (V4, "127.0.0.1", "10.0.0.1", "loopback"),
        (V4, "127.9.8.7", None, "loopback"),
        (V4, "10.0.0.5", "10.0.0.5", "loopback"),
        (V4, "0.0.0.0", "0.0.0.0", "external"),
        (V4, "10.0.0.5", "10.0.0.6", "external"),
        (V4, "10.0.0.127", "10.0.0.6", "external"),
        (V4, "10.0.0.5", None, "external"),
        (V6, "::1", "::1", "loopback"),
        (V6, "::ffff:127.1.2.3", "::", "loopback"),
        (V6, "::ffff:10.0.0.1", "::", "external"),
        (V6, "2001:db8::1", "2001:db8::1", "external"),
        (V6, "::", "::", "external"),
        (1, None, None, "external"),
        (None, "127.0.0.1", None, "external"),
    ],
)
def test_scope(spark, family, dest, source, scope):
    row = spark.createDataFrame(
        [(family, address(dest), address(source))], "family int, daddr binary, saddr binary"
    )
    assert row.select(scope_of(F.col("family"), F.col("daddr"), F.col("saddr"))).first()[0] == scope


def test_direction(spark):
    hooks = ["tcp_sendmsg", "udp_sendmsg", "udpv6_sendmsg", "tcp_cleanup_rbuf", "udp_recvmsg", "udpv6_recvmsg", "x"]
    rows = spark.createDataFrame([(h,) for h in hooks], "hook string")
    found = dict(rows.select("hook", direction_of_hook(F.col("hook"))).collect())
    assert [found[h] for h in hooks] == ["egress"] * 3 + ["ingress"] * 3 + [None]


def sample(i, ts, tgid, hook, ret, host="h"):
    return (i, ts, host, tgid, hook, ret, V4, address("10.0.0.1"), address("10.0.0.2"))


def test_errors_and_empty_transfers_are_no_traffic(spark):
    t = utc(2024, 1, 1, 0, 0, 30)
    df = spark.createDataFrame(
        [sample(1, t, 1, "tcp_sendmsg", -11), sample(2, t, 1, "tcp_sendmsg", 0), sample(3, t, 1, "tcp_sendmsg", 5),
         sample(4, t, 1, "unknown", 7)],
        SOCKET_SAMPLE,
    )
    assert rows_of(smp.counter_fold(smp.transfers(df))) == [("h", 1, "egress", "external", 5)]


def test_minute_fold_and_open_minute(spark):
    df = spark.createDataFrame(
        [
            sample(1, utc(2024, 1, 1, 0, 0, 59), 1, "tcp_sendmsg", 10),
            sample(2, utc(2024, 1, 1, 0, 0, 0), 1, "tcp_cleanup_rbuf", 3),
            sample(3, utc(2024, 1, 1, 0, 1, 0), 1, "tcp_sendmsg", 2),
        ],
        SOCKET_SAMPLE,
    )
    folds = smp.minute_fold(df).withColumn("m", F.unix_seconds("bucket") - F.unix_seconds(F.lit(utc(2024, 1, 1))))
    assert rows_of(folds, "m", "ingress_bytes", "egress_bytes") == [(0, 3, 10), (60, 0, 2)]
    closed = smp.closed_minutes(folds, utc(2024, 1, 1, 0, 1, 30))
    assert rows_of(closed, "m", "ingress_bytes", "egress_bytes") == [(0, 3, 10)]


def test_unknown_direction_adds_nothing(spark):
    moved = spark.createDataFrame(
        [("k", "ingress", 5), ("k", "egress", 7), ("k", "other", 100), ("z", "other", 1)], "k string, dir string, bytes long"
    )
    assert rows_of(smp.direction_pivot(moved, "k")) == [("k", 5, 7), ("z", 0, 0)]


def test_first_sight_keeps_the_first(spark):
    seen = spark.createDataFrame(
        [("h", 1, 5, "late"), ("h", 1, 2, "early"), ("h", 2, 9, "only")], "host string, tgid long, at long, comm string"
    )
    assert rows_of(smp.first_sight(seen, ["comm"], ["at"])) == [("h", 1, "early"), ("h", 2, "only")]
