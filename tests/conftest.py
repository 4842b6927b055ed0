"""One local session for the whole test run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tesserae.session import get_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = get_session(
        "tests",
        master="local[4]",
        spark__sql__shuffle__partitions=4,
        spark__ui__enabled="false",
        spark__checkpoint__dir=f"file://{shared}",
        spark__sql__warehouse__dir=f"{shared}/warehouse",
        spark__driver__memory="3g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    return DATA
