import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from itemweld.session import local_session
    session = local_session(os.environ.get("TEST_CPUS", "8"), app="itemweld-tests")
    yield session
    session.stop()


@pytest.fixture
def stages(spark):
    from itemweld.sources.staging import Stages
    return Stages(spark, "test")
