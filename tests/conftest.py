import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from palimpsest.session import get_spark

    s = get_spark("tests", "local[4]", 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
