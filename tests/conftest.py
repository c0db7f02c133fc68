import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from driftnet.session import local_session

    return local_session(cores=4, memory="4g", shuffle_partitions=4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
