import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rolemill import catalog
from rolemill.session import build_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    catalog.load()
    session = build_session("tests", 8, shuffle=4, shared=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()
