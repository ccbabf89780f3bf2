import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.session import local_session  # noqa: E402
from tidemark.streaming.stateful import STATE_STORE  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "tests",
        cores="4",
        conf={
            "spark.sql.shuffle.partitions": "2",
            # keep the few chunks of small inputs apart, so that the split paths are really split
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            **STATE_STORE,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
