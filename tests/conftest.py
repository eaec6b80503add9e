import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("LOGWEAVE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from logweave.session import get_session

    s = get_session("local[2]", app="logweave-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
