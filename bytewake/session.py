"""Session settings the engine relies on, and its shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import cache

from pyspark.sql import SparkSession

#: values that are looked up by themselves; more are joined
FEW = 200

# Settable at run time on any session, including one that is handed to us.
RUNTIME_CONF = {
    # stored instants are UTC; local calendars are reached through explicit zones
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a busy key is split over tasks even where that costs one more shuffle
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # shuffles start out in many parts and are merged up to this size, so what one task sorts or hashes stays
    # the same however large the tables are; twice the rows are twice the tasks
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # and so does what one task folds of a file before the shuffle
    "spark.sql.files.maxPartitionBytes": "32m",
    # INT96 timestamps carry no statistics, so bucket ranges would not be pushed down
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    # a list of that many values is looked up in statistics and bloom filters of row groups one by one
    "spark.sql.parquet.pushdown.inFilterThreshold": str(FEW),
    # many named date folders are listed by some tasks, not by one task each
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # streaming state lives on disk next to the executor, not on its heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # and only its changes are uploaded after each micro-batch
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "bytewake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the parent in ``spark.checkpoint.dir``.  Only a
    single-machine session without that setting gets a local folder.
    """
    return shared_dir(spark, f"{label}-{uuid.uuid4().hex}")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A folder of a name that is known again later; see ``work_dir``."""
    parent = spark.conf.get("spark.checkpoint.dir", None)
    if not parent:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        parent = _local_parent()
    return f"{parent.rstrip('/')}/{name}"


@cache
def _local_parent() -> str:
    return tempfile.mkdtemp(prefix="bytewake-")


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def folders(spark: SparkSession, path: str, files: bool = False) -> list[str]:
    """Names of the folders (or files) directly in a folder, none if it is not there; hidden ones are left out."""
    system, target = _file_system(spark, path)
    if not system.exists(target):
        return []
    found = (x for x in system.listStatus(target) if x.isDirectory() != files)
    return sorted(name for x in found if not (name := x.getPath().getName()).startswith(("_", ".")))


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern; only the folders that it names or passes through are looked at."""
    system, target = _file_system(spark, pattern)
    found = system.globStatus(target)
    if not found:
        return []
    # all names in one call, for thousands of folders are thousands of calls; names hold no slash, so what
    # stands between two paths is known
    jvm = spark.sparkContext._jvm
    fixed = pattern[:re.search(r"[*?\[{]|$", pattern).start()].rpartition("/")[0]
    parent = system.makeQualified(jvm.org.apache.hadoop.fs.Path(fixed)).toString().rstrip("/") + "/"
    told = jvm.org.apache.commons.lang3.ArrayUtils.toString(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    return sorted(parent + rest for rest in told[1:-1].removeprefix(parent).split(f",{parent}"))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders on whatever file system holds them."""
    # looked up once, not for every path
    path_of, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def delete(path: str) -> None:
        target = path_of(path)
        target.getFileSystem(conf).delete(target, True)

    if len(paths) < 8:
        for path in paths:
            delete(path)
    else:  # many folders are many calls to a store
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(delete, paths))
