import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from weftlight.session import local_session, ship  # noqa: E402

#: Small tables of the driver.
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
