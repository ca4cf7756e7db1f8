from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from filmloom.session import build_session, ship_package
    session = build_session("tests", "local[8]", {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                                  "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
