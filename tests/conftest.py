import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tollgate.session import get_session
    s = get_session("local[4]", 4, extra={
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # a single machine: a scratch folder stands in for the cluster's shared one
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tollgate-test-")})
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tollgate-t-")
