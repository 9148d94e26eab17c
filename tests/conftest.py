import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    from oracle import session
    from seriesloom.session import apply_settings

    s = session()
    s.sparkContext.setLogLevel("ERROR")
    yield apply_settings(s)
    s.stop()
