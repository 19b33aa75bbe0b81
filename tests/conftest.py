import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from corpusmill.tables import get_spark, ship

    s = get_spark("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
