import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
SF_BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="session")
def spark():
    from vecbench.session import local_session
    s = local_session("*", shuffle_partitions=8, app="vecbench-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
