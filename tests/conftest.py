import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("LEAFLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from leafloom.session import local_session

    session = local_session(4, 4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def middle():
    return "/root/testdata/sf0.01"
