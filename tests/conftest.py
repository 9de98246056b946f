import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fieldflux.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
