import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stepweave.operators import ordered  # noqa: E402
from stepweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="6g", partitions=4)
    yield session
    session.stop()


@pytest.fixture(params=["whole", "split"])
def either(request, spark):
    """Run a test with groups left whole and with groups cut into small blocks."""
    if request.param == "split":
        spark.conf.set(ordered.SPLIT_ROWS, "6")
    yield spark
    spark.conf.unset(ordered.SPLIT_ROWS)
