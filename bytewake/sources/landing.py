"""Landed feeds: Parquet folders with declared schemas, as tables or streams."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from bytewake import schemas
from bytewake.functions import calendar


def _scan(spark: SparkSession, path: str, schema: StructType, streaming: bool = False, **options) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).options(**options).parquet(path)


def land_samples(samples: DataFrame, path: str) -> None:
    """Append samples to a landing folder, by UTC date."""
    samples.withColumn("dt", calendar.utc_date(F.col("ts"))).write.mode("append").partitionBy("dt").parquet(path)


def scan_samples(
    spark: SparkSession, path: str, streaming: bool = False, window: tuple[datetime, datetime] | None = None, **options
) -> DataFrame:
    """Transfer samples; the same transformations apply to table and stream.

    A ``window`` [from, to) of a folder written by ``land_samples`` reads the
    folders of its dates only.
    """
    if window is None:
        return _scan(spark, path, schemas.SOCKET_SAMPLE, streaming, **options)
    start, end = (m if m.tzinfo else m.replace(tzinfo=timezone.utc) for m in window)
    dated = StructType([*schemas.SOCKET_SAMPLE.fields, StructField("dt", DateType())])
    rows = _scan(spark, path, dated, streaming, **options)
    days = F.col("dt").between(F.lit(start.astimezone(timezone.utc).date()), F.lit(end.astimezone(timezone.utc).date()))
    return rows.where(days & (F.col("ts") >= calendar.at(start)) & (F.col("ts") < calendar.at(end))).drop("dt")


def scan_proc_snapshots(spark: SparkSession, path: str, streaming: bool = False, **options) -> DataFrame:
    return _scan(spark, path, schemas.PROC_SNAPSHOT, streaming, **options)


def scan_pid_meta(spark: SparkSession, path: str) -> DataFrame:
    """Fallback metadata: every capture, for each may be another owner of the process number."""
    return _scan(spark, path, schemas.PID_META)


def first_capture(meta: DataFrame) -> DataFrame:
    """Of captures of one lifetime (see ``identity.captures``) the first; later ones are ignored."""
    first = F.min_by(F.struct("uid", "cgroup_id", "comm", "captured_at"), F.struct("captured_at", "uid", "cgroup_id", "comm"))
    return meta.groupBy("host", "tgid", "gen_start").agg(first.alias("first")).select("host", "tgid", "gen_start", "first.*")


def scan_passwd(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.PASSWD)


def scan_project_markers(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.PROJECT_MARKER)


def json_sink(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON record per row."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
