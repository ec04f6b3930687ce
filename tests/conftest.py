import os
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bytewake.session import tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[4]")
        .appName("bytewake-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        # list the few folders of a test on the driver
        .config("spark.sql.sources.parallelPartitionDiscovery.threshold", "1000")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def rows_of(df, *columns):
    """Sorted tuples of a DataFrame; instants come back as UTC."""
    columns = columns or df.columns
    return sorted((tuple(row[c] for c in columns) for row in df.select(*columns).collect()), key=repr)
