import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from facsimile.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "facsimile-tests", spark__sql__shuffle__partitions="8")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture
def small_buckets(spark):
    """Force ordered scans through many buckets and lookups through the shuffle path."""
    keep = {"facsimile.rowsPerBucket": "500000", "facsimile.boundedRows": "20000", "facsimile.exactPercentileRows": "5000000"}
    spark.conf.set("facsimile.rowsPerBucket", "40")
    spark.conf.set("facsimile.boundedRows", "3")
    spark.conf.set("facsimile.exactPercentileRows", "10")
    yield spark
    for k, v in keep.items():
        spark.conf.set(k, v)
