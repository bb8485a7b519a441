import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from folioforge.session import local_session, ship

    session = local_session("tests", cores="4", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    session.conf.set("spark.sql.adaptive.enabled", "true")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
