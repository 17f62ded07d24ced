import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import pytest

from ledgerloom.plans.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)
