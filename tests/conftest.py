import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from quillspark.session import build_session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g"
    )
    s.sparkContext.setLogLevel("OFF")
    ship_package(s)
    yield s


@pytest.fixture(scope="session")
def data():
    return os.environ.get("QUILLSPARK_TESTDATA", "/root/testdata")
