"""Declared schemas of every table; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_long, _string, _int, _ts = T.LongType(), T.StringType(), T.IntegerType(), T.TimestampType()

# One observed transfer.  Addresses are network-order bytes, 4 or 16 of them.
SOCKET_SAMPLE = _struct(
    ("sample_id", _long), ("ts", _ts), ("host", _string), ("tgid", _long), ("hook", _string),
    ("ret", _long), ("family", _int), ("daddr", T.BinaryType()), ("saddr", T.BinaryType()),
)

# Raw process fields, captured when a process is first seen.
PROC_SNAPSHOT = _struct(
    ("host", _string), ("tgid", _long), ("seen_at", _ts), ("exe", _string), ("cwd", _string),
    ("comm", _string), ("cmdline", _string), ("status", _string), ("cgroup", _string),
)

# Fallback metadata that outlives the process.
PID_META = _struct(
    ("host", _string), ("tgid", _long), ("uid", _long), ("cgroup_id", _string), ("comm", _string),
    ("captured_at", _ts),
)

PASSWD = _struct(("host", _string), ("line_no", _long), ("uid", _long), ("username", _string))

PROJECT_MARKER = _struct(("host", _string), ("dir", _string), ("marker", _string))

IDENTITY = _struct(
    ("id", _long), ("host", _string), ("uid", _long), ("unit_or_cgroup", _string),
    ("exe", _string), ("project_root", _string), ("normalized_cmdline", _string),
    ("comm", _string), ("raw_cmdline", _string), ("username", _string),
    ("first_seen", _ts), ("last_seen", _ts),
)

TRAFFIC = _struct(
    ("bucket", _ts), ("identity_id", _long), ("scope", _string),
    ("ingress_bytes", _long), ("egress_bytes", _long),
)

# What a reader of the store may see; see sources/store.py.
COMMIT = _struct(
    ("seq", _long), ("tier", _string), ("action", _string), ("batch_id", _string), ("attempt", _string),
    ("dt", T.DateType()), ("from_ts", _ts), ("to_ts", _ts), ("n", _long),
)


# The partition columns of facts and of identities at rest.
TRAFFIC_STORED = T.StructType(
    TRAFFIC.fields + _struct(("dt", T.DateType()), ("batch_id", _string)).fields
)
IDENTITY_STORED = T.StructType(IDENTITY.fields + _struct(("bucket", _int), ("batch_id", _string)).fields)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows; the optimizer sees that and drops what is joined with it."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
