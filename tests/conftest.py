import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from microfolio.session import local_session, remove_stages  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "microfolio-tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    remove_stages(session)
    session.stop()
