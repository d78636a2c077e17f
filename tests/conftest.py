import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trilect.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cores="4", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def data_dir():
    return os.environ.get("TRILECT_DATA", "/root/testdata/sf0.001")
