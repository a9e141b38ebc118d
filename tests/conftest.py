import os
import pathlib
import sys

import pytest

ROOT = str(pathlib.Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
sys.path.insert(0, ROOT + "/tests")


@pytest.fixture(scope="session")
def spark():
    from catamatch.session import local_session

    return local_session(os.environ.get("TEST_CPUS", "8"), "tests")
