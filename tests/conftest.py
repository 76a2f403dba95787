import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("SIFTWELL_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from siftwell.session import local_session

    s = local_session(4, app="tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()
