import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = Path(os.environ.get("VELLUM_TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    from vellum.session import local_session, ship

    session = local_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    path = DATA / "sf0.001"
    if not path.exists():
        pytest.skip("the generated tables are not here")
    return str(path)
