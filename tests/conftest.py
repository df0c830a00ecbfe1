import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from traceloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return session
