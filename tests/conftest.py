import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    from marlstone.session import local_session

    s = local_session(8, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
