import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparkweave.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("*", shuffle_partitions=8, app_name="sparkweave-tests")
    yield s


@pytest.fixture()
def tmp(spark):
    """A new folder below the shared root (spark.checkpoint.dir) per test."""
    from sparkweave.session import fresh_path
    return fresh_path(spark, "tests")


@pytest.fixture()
def local_tmp():
    return tempfile.mkdtemp(prefix="sw-test-")
