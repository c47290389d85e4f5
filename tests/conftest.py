import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowtrace.session import get_spark
    ck = tempfile.mkdtemp(prefix="flowtrace-test-ck-", dir="/tmp")
    s = get_spark("local[4]", shuffle_partitions=8, checkpoint_dir=ck)
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    from flowtrace.sources.csvio import scratch_path
    return lambda name: scratch_path(spark, name)
