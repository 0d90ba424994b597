import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers inherit the environment: let them import the package and
# the test modules whose functions are shipped to them.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from snippetflow.session import get_session
    s = get_session("local[*]", 8)
    yield s
    s.stop()
