import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from parlance.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = get_session("local[8]", app="tests", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__checkpoint__dir=str(shared))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
