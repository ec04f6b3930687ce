"""Traffic-shaped views over the driver tables (FIXTURES.md).

Each view is one SQL text for Spark and DuckDB; ``{table}`` stands for a driver
table and ``{each:1, 2}`` for one row per listed value, the only thing the two
spell differently.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bytewake import schemas
from bytewake.config import DISPLAY, NATURAL_KEY
from bytewake.session import folders, tune, work_dir

TZ = "America/New_York"
SAMPLES_NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
WIDE_NOW = datetime(2001, 11, 5, tzinfo=timezone.utc)
SECOND_BATCH = datetime(2024, 1, 16, tzinfo=timezone.utc)

VIEWS = {
    "socket_sample": """
SELECT event_id AS sample_id, ts, 'h' || CAST(user_id % 4 AS VARCHAR(9)) AS host, user_id AS tgid,
  CASE event_type WHEN 'click' THEN 'tcp_sendmsg' WHEN 'purchase' THEN 'udp_sendmsg'
    WHEN 'view' THEN 'tcp_cleanup_rbuf' WHEN 'signup' THEN 'udp_recvmsg' ELSE 'udpv6_sendmsg' END AS hook,
  CAST(round(value * 100) AS BIGINT) * (CASE WHEN event_type = 'error' AND k % 2 = 0 THEN -1 ELSE 1 END) AS ret,
  CASE WHEN k % 7 IN (3, 4, 5) THEN 10 WHEN k % 7 = 6 THEN 1 ELSE 2 END AS family,
  CASE k % 7 WHEN 0 THEN '7F000001' WHEN 1 THEN '0A000005' WHEN 2 THEN '00000000'
    WHEN 3 THEN '00000000000000000000000000000001' WHEN 4 THEN '00000000000000000000FFFF7F000009'
    WHEN 5 THEN '20010DB8000000000000000000000001' END AS daddr_hex,
  CASE k % 7 WHEN 0 THEN '0A000005' WHEN 1 THEN '0A000005' WHEN 2 THEN '00000000' END AS saddr_hex
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e""",
    "proc_snapshot": """
SELECT 'h' || CAST(c_custkey % 4 AS VARCHAR(9)) AS host, c_custkey AS tgid,
  CASE WHEN g = 1 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-16 00:00:00' END AS seen_at,
  '/usr/bin/' || lower(c_mktsegment) || CASE WHEN c_custkey % 11 = 0 THEN ' (deleted)' ELSE '' END AS exe,
  '/home/u' || CAST(c_nationkey AS VARCHAR(9)) || '/' || lower(c_mktsegment) || '/src/lib' AS cwd,
  lower(c_mktsegment) || chr(10) AS comm,
  'app' || chr(0) || CASE WHEN g = 1 THEN 'run' ELSE 'build' END || chr(0) || '--port' || chr(0) || CAST(c_custkey AS VARCHAR(9))
    || chr(0) || chr(0) || '--name=' || c_name || chr(0) || '/tmp/x' || CAST(c_custkey AS VARCHAR(9)) || chr(0)
    || CASE WHEN c_custkey % 3 = 0 THEN '3f6c1a92-7b0e-4d58-8c21-e94a07d5b16f'
            WHEN c_custkey % 3 = 1 THEN 'tool7.py' ELSE '3.5e2' END AS cmdline,
  'Name:' || chr(9) || lower(c_mktsegment) || chr(10) || 'Uid:' || chr(9) || CAST(1000 + c_nationkey AS VARCHAR(9)) || chr(9) || '0' AS status,
  CASE WHEN c_custkey % 13 = 0 THEN 'junk' || chr(10) ELSE '' END || '0::/user.slice/' || lower(c_mktsegment) || '.scope' AS cgroup
FROM (SELECT *, {each:1, 2} AS g FROM {customer}) c
WHERE c_custkey % 5 <> 0 AND (g = 1 OR c_custkey % 6 = 1)""",
    "pid_meta": """
SELECT 'h' || CAST(c_custkey % 4 AS VARCHAR(9)) AS host, c_custkey AS tgid, CAST(1000 + c_nationkey AS BIGINT) AS uid,
  CAST(c_custkey % 7 AS VARCHAR(20)) AS cgroup_id, CASE WHEN g = 1 THEN lower(c_mktsegment) ELSE 'reused' END || chr(0) || chr(0) AS comm,
  CASE WHEN g = 1 THEN TIMESTAMP '2024-01-01 00:00:05' ELSE TIMESTAMP '2024-01-20 11:12:13' END AS captured_at
FROM (SELECT *, {each:1, 2} AS g FROM {customer}) c WHERE c_custkey % 10 <> 0 AND (g = 1 OR c_custkey % 4 = 1)""",
    "passwd": """
SELECT 'h' || CAST(x AS VARCHAR(9)) AS host, CAST(n_nationkey + 25 * d AS BIGINT) AS line_no,
  CAST(1000 + n_nationkey AS BIGINT) AS uid, n_name || CASE WHEN d = 1 THEN '_alt' ELSE '' END AS username
FROM (SELECT *, {each:0, 1} AS d FROM (SELECT *, {each:0, 1, 2, 3} AS x FROM {nation}) h) n
WHERE n_nationkey < 20 AND (d = 0 OR n_nationkey % 4 = 0)""",
    "project_marker": """
SELECT 'h' || CAST(x AS VARCHAR(9)) AS host, dir, marker FROM (SELECT *, {each:0, 1, 2, 3} AS x FROM (
  SELECT '/home/u' || CAST(n_nationkey AS VARCHAR(9)) AS dir, '.git' AS marker FROM {nation} WHERE n_nationkey % 2 = 0
  UNION ALL SELECT '/home/u' || CAST(n_nationkey AS VARCHAR(9)) || '/machinery', 'Cargo.toml' FROM {nation} WHERE n_nationkey % 3 = 0
  UNION ALL SELECT '/home/u' || CAST(n_nationkey AS VARCHAR(9)) || '/building', 'README.md' FROM {nation}) m) h""",
    "traffic_wide": """
SELECT bucket, identity_id, scope, CAST(sum(i) AS BIGINT) AS ingress_bytes, CAST(sum(e) AS BIGINT) AS egress_bytes FROM (
  SELECT l_shipdate + ((l_orderkey * 7 + l_linenumber * 97) % 1440) * INTERVAL '1' MINUTE AS bucket, l_suppkey AS identity_id,
    CASE WHEN l_returnflag = 'R' THEN 'loopback' ELSE 'external' END AS scope,
    CAST(round(l_quantity * 100) AS BIGINT) AS i, CAST(round(l_extendedprice * 100) AS BIGINT) AS e FROM {lineitem}) t
GROUP BY bucket, identity_id, scope""",
    # One identity per supplier, for the verbs over traffic_wide.
    "identity_wide": """
SELECT s_suppkey AS id, 'h' || CAST(s_suppkey % 4 AS VARCHAR(9)) AS host,
  CASE WHEN s_suppkey % 17 = 5 THEN CAST(4294967295 AS BIGINT) ELSE CAST(1000 + s_nationkey AS BIGINT) END AS uid,
  CASE WHEN s_suppkey % 10 = 3 THEN 'cgroup-id:' || CAST(s_suppkey AS VARCHAR(20)) ELSE '/user.slice/s' || CAST(s_suppkey % 6 AS VARCHAR(9)) || '.scope' END AS unit_or_cgroup,
  CASE WHEN s_suppkey % 10 = 3 THEN '<unresolved>' ELSE '/usr/bin/app' || CAST(s_suppkey % 12 AS VARCHAR(9)) END AS exe,
  CASE WHEN s_suppkey % 10 = 3 THEN '<unresolved>' WHEN s_suppkey % 5 = 0 THEN '<none>'
    ELSE '/home/u' || CAST(s_nationkey AS VARCHAR(9)) || '/p' || CAST(s_suppkey % 7 AS VARCHAR(9)) END AS project_root,
  CASE WHEN s_suppkey % 10 = 3 THEN '<unresolved:c>' ELSE 'app run ' || s_name END AS normalized_cmdline,
  CASE WHEN s_suppkey % 9 <> 4 THEN 'c_' || CAST(s_suppkey % 8 AS VARCHAR(9)) END AS comm,
  'app run ' || s_name AS raw_cmdline, CASE WHEN n_nationkey < 20 THEN n_name END AS username,
  TIMESTAMP '1995-01-01 00:00:00' AS first_seen, TIMESTAMP '2001-11-04 00:00:00' AS last_seen
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
}


def _spell(sql: str, opening: str, closing: str) -> str:
    return re.sub(r"\{each:([^}]*)\}", rf"{opening}\1{closing}", sql)


def spark_view(name: str) -> str:
    return _spell(VIEWS[name], "explode(array(", "))")


def duckdb_view(name: str) -> str:
    return _spell(VIEWS[name], "unnest([", "])").replace("{", "").replace("}", "")


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _tables_of(sql: str) -> list[str]:
    names = ("events", "customer", "nation", "lineitem", "supplier")
    return [name for name in names if "{" + name + "}" in sql]


def view(spark: SparkSession, sf_dir: str, name: str, **replaced: DataFrame) -> DataFrame:
    """A view as DataFrame, instants as TIMESTAMP."""
    tune(spark)
    sql = spark_view(name)
    inputs = {t: replaced[t] if t in replaced else table(spark, sf_dir, t) for t in _tables_of(sql)}
    rows = spark.sql(sql, **inputs)
    for column in ("ts", "bucket", "seen_at", "captured_at", "first_seen", "last_seen"):
        if column in rows.columns:
            rows = rows.withColumn(column, F.col(column).cast("timestamp"))
    return rows


def samples(spark: SparkSession, sf_dir: str, **replaced: DataFrame) -> DataFrame:
    """socket_sample with addresses as bytes, the shape the operators take."""
    rows = view(spark, sf_dir, "socket_sample", **replaced)
    return rows.select(
        "sample_id", "ts", "host", "tgid", "hook", "ret", "family",
        F.unhex("daddr_hex").alias("daddr"), F.unhex("saddr_hex").alias("saddr"),
    )


def sample_stream(spark: SparkSession, sf_dir: str, *borders: str) -> DataFrame:
    """The same samples as a file stream: one micro-batch up to each border, and one after the last.

    Each micro-batch is as many files as the table is read in pieces.
    """
    tune(spark)
    events, path = table(spark, sf_dir, "events"), work_dir(spark, "events")
    pieces = max(1, events.rdd.getNumPartitions())
    bounds = [F.lit(b).cast("timestamp") for b in borders]
    for number, (after, until) in enumerate(zip([None, *bounds], [*bounds, None]), 1):
        part = events if after is None else events.where(F.col("ts") >= after)
        part = part if until is None else part.where(F.col("ts") < until)
        part.repartition(pieces, "event_id").write.mode("append").parquet(path)
        # a piece without rows wrote no file, but a micro-batch is told by their number
        while len(folders(spark, path, files=True)) < number * pieces:
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", pieces).parquet(path)
    return samples(spark, sf_dir, events=stream)


def empty_identities(spark: SparkSession) -> DataFrame:
    return schemas.empty(spark, schemas.IDENTITY)


# -- the oracle side --------------------------------------------------------

MOVED = """
SELECT sample_id, host, tgid, ts,
  CASE WHEN hook IN ('tcp_sendmsg', 'udp_sendmsg', 'udpv6_sendmsg') THEN 'egress' ELSE 'ingress' END AS dir,
  CASE WHEN family = 2 AND (daddr_hex LIKE '7F%' OR (daddr_hex <> '00000000' AND daddr_hex = saddr_hex)) THEN 'loopback'
       WHEN family = 10 AND (daddr_hex = '00000000000000000000000000000001' OR daddr_hex LIKE '00000000000000000000FFFF7F%') THEN 'loopback'
       ELSE 'external' END AS scope,
  ret AS bytes
FROM socket_sample WHERE ret > 0"""

PAIR = """CAST(sum(CASE WHEN dir = 'ingress' THEN bytes ELSE 0 END) AS BIGINT) AS ingress_bytes,
  CAST(sum(CASE WHEN dir = 'egress' THEN bytes ELSE 0 END) AS BIGINT) AS egress_bytes"""

SUMS = """CAST(sum(ingress_bytes) AS BIGINT) AS ingress_bytes, CAST(sum(egress_bytes) AS BIGINT) AS egress_bytes"""

KEY = ", ".join(NATURAL_KEY)
DISPLAYED = ", ".join(DISPLAY)

PARTS = {
    **{name: duckdb_view(name) for name in VIEWS},
    "moved": MOVED,
    "clean": r"""
SELECT host, tgid, seen_at, regexp_replace(exe, '( \(deleted\))+$', '') AS exe, cwd, trim(comm, ' ' || chr(10)) AS comm,
  array_to_string(list_filter(string_split(cmdline, chr(0)), lambda x: x <> ''), ' ') AS raw_cmdline,
  CAST(regexp_extract(status, 'Uid:\s*([0-9]+)', 1) AS BIGINT) AS uid,
  coalesce(array_to_string(string_split(list_filter(string_split(cgroup, chr(10)),
    lambda l: len(string_split(l, ':')) >= 3)[1], ':')[3:], ':'), '') AS unit_or_cgroup
FROM proc_snapshot""",
    "roots": """
SELECT c.host, c.cwd, arg_max(m.dir, length(m.dir)) AS project_root
FROM (SELECT DISTINCT host, cwd FROM clean) c
JOIN project_marker m ON m.host = c.host AND (c.cwd = m.dir OR starts_with(c.cwd, m.dir || '/'))
WHERE m.marker IN ('.git', 'package.json', 'pyproject.toml', 'Cargo.toml') GROUP BY c.host, c.cwd""",
    "names": """
SELECT host, uid, username FROM passwd
QUALIFY row_number() OVER (PARTITION BY host, uid ORDER BY line_no) = 1""",
    "masked": r"""
SELECT DISTINCT raw_cmdline, array_to_string(list_transform(
  list_filter(regexp_split_to_array(raw_cmdline, '\s+'), lambda t: t <> ''), lambda t:
    CASE WHEN contains(t, '=') THEN split_part(t, '=', 1) || '=<v>'
         WHEN regexp_full_match(t, '[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}') THEN '<uuid>'
         WHEN starts_with(t, '/tmp/') OR starts_with(t, '/proc/') THEN '<path>'
         WHEN regexp_full_match(lower(t), '[+-]?(inf|infinity|nan|([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?)') THEN '<n>'
         ELSE t END), ' ') AS normalized_cmdline FROM clean""",
    "live": f"""
SELECT c.tgid, c.seen_at, c.host, c.uid, c.unit_or_cgroup, c.exe, coalesce(r.project_root, '<none>') AS project_root,
  k.normalized_cmdline, c.comm, c.raw_cmdline, n.username
FROM clean c LEFT JOIN roots r ON r.host = c.host AND r.cwd = c.cwd
LEFT JOIN names n ON n.host = c.host AND n.uid = c.uid JOIN masked k ON k.raw_cmdline = c.raw_cmdline""",
    "captured": """
SELECT m.*, coalesce(
  (SELECT max(s.seen_at) FROM proc_snapshot s WHERE s.host = m.host AND s.tgid = m.tgid
    AND s.seen_at <= m.captured_at AND s.seen_at >= m.captured_at - INTERVAL 10 SECOND),
  (SELECT min(s.seen_at) FROM proc_snapshot s WHERE s.host = m.host AND s.tgid = m.tgid
    AND s.seen_at >= m.captured_at AND s.seen_at <= m.captured_at + INTERVAL 10 SECOND), m.captured_at) AS gen_start
FROM pid_meta m""",
    "degraded": """
SELECT m.tgid, m.gen_start, m.host, m.uid, 'cgroup-id:' || m.cgroup_id AS unit_or_cgroup, '<unresolved>' AS exe,
  '<unresolved>' AS project_root, '<unresolved:' || split_part(m.comm, chr(0), 1) || '>' AS normalized_cmdline,
  split_part(m.comm, chr(0), 1) AS comm, '' AS raw_cmdline, n.username
FROM captured m LEFT JOIN names n ON n.host = m.host AND n.uid = m.uid""",
    "generation": """
SELECT host, tgid, started AS gen_start,
  lead(started) OVER (PARTITION BY host, tgid ORDER BY started) AS gen_end,
  row_number() OVER (PARTITION BY host, tgid ORDER BY started) AS n
FROM (SELECT host, tgid, seen_at AS started FROM proc_snapshot UNION SELECT host, tgid, gen_start FROM captured) s""",
    "placed": """
SELECT m.*, g.gen_start FROM moved m LEFT JOIN generation g ON g.host = m.host AND g.tgid = m.tgid
  AND (m.ts >= g.gen_start OR g.n = 1) AND (m.ts < g.gen_end OR g.gen_end IS NULL)""",
    "attributed": """
SELECT p.ts, p.tgid, p.gen_start, p.dir, p.scope, p.bytes, p.host,
  CASE WHEN l.host IS NOT NULL THEN 'snapshot' WHEN d.host IS NOT NULL THEN 'metadata' ELSE 'none' END AS source,
  CASE WHEN l.host IS NOT NULL THEN l.uid WHEN d.host IS NOT NULL THEN d.uid ELSE 4294967295 END AS uid,
  CASE WHEN l.host IS NOT NULL THEN l.unit_or_cgroup WHEN d.host IS NOT NULL THEN d.unit_or_cgroup ELSE '<unresolved>' END AS unit_or_cgroup,
  CASE WHEN l.host IS NOT NULL THEN l.exe ELSE '<unresolved>' END AS exe,
  CASE WHEN l.host IS NOT NULL THEN l.project_root ELSE '<unresolved>' END AS project_root,
  CASE WHEN l.host IS NOT NULL THEN l.normalized_cmdline WHEN d.host IS NOT NULL THEN d.normalized_cmdline ELSE '<unresolved>' END AS normalized_cmdline
FROM placed p LEFT JOIN live l ON l.host = p.host AND l.tgid = p.tgid AND l.seen_at = p.gen_start
LEFT JOIN degraded d ON d.host = p.host AND d.tgid = p.tgid AND d.gen_start = p.gen_start""",
    "hours": f"""
SELECT date_trunc('hour', bucket) AS bucket, identity_id, scope, {SUMS} FROM traffic_wide
WHERE bucket < TIMESTAMP '2001-11-05 00:00:00' GROUP BY 1, 2, 3""",
    "days": f"""
SELECT (date_trunc('day', (bucket AT TIME ZONE 'UTC') AT TIME ZONE '{TZ}') AT TIME ZONE '{TZ}') AT TIME ZONE 'UTC' AS bucket,
  identity_id, scope, {SUMS} FROM hours GROUP BY 1, 2, 3""",
    "months": f"""
SELECT (date_trunc('month', (bucket AT TIME ZONE 'UTC') AT TIME ZONE '{TZ}') AT TIME ZONE '{TZ}') AT TIME ZONE 'UTC' AS bucket,
  identity_id, scope, {SUMS} FROM days WHERE bucket < TIMESTAMP '2001-11-04 05:00:00' GROUP BY 1, 2, 3""",
}

# What each part reads, in the order the WITH clause needs.
NEEDS = {
    "moved": ["socket_sample"],
    "clean": ["proc_snapshot"],
    "roots": ["clean", "project_marker"],
    "names": ["passwd"],
    "masked": ["clean"],
    "live": ["clean", "roots", "names", "masked"],
    "captured": ["pid_meta", "proc_snapshot"],
    "degraded": ["captured", "names"],
    "generation": ["proc_snapshot", "captured"],
    "placed": ["moved", "generation"],
    "attributed": ["placed", "live", "degraded"],
    "hours": ["traffic_wide"],
    "days": ["hours"],
    "months": ["days"],
}


def oracle(body: str, *parts: str, **extra: str) -> str:
    """``body`` behind the WITH clause of all parts it needs."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for before in NEEDS.get(name, []):
            need(before)
        if name not in ordered:
            ordered.append(name)

    for part in parts:
        need(part)
    clauses = [f"{name} AS ({PARTS[name]})" for name in ordered]
    clauses += [f"{name} AS ({sql})" for name, sql in extra.items()]
    return f"WITH {', '.join(clauses)}\n{body}"


def ms(column: str, alias: str) -> str:
    return f"CAST(epoch_ms({column}) AS BIGINT) AS {alias}"


def us(column: str, alias: str) -> str:
    return f"CAST(epoch_us({column}) AS BIGINT) AS {alias}"
