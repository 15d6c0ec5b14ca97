import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from telespark.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("8", partitions=4, app="telespark-tests")
    yield s
    s.stop()
