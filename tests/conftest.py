"""One small local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from skein.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "4", shuffle_partitions=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")), spark__driver__memory="4g")
    yield session
    session.stop()
