import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .appName("pitchframe-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tiny_groups(spark):
    """Force the block-wise plans by allowing only a few rows per group."""
    from pitchframe.plans.skew import MAX_GROUP_ROWS_CONF

    spark.conf.set(MAX_GROUP_ROWS_CONF, "40")
    yield
    spark.conf.unset(MAX_GROUP_ROWS_CONF)


def rows(df, *order):
    """Collected rows as tuples, sorted by the given columns."""
    return [tuple(r) for r in df.orderBy(*order).collect()]
