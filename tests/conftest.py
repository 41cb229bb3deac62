import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import local_session

    s = local_session(4, 4, "4g", **{"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.exists(DATA):
        pytest.skip("no test tables")
    return DATA
