import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pairforge.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, driver_memory="8g")
    yield s


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


SF_SMOKE = "/root/testdata/sf0.001"
