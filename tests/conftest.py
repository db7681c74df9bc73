import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from noticework.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=8, memory="6g")


@pytest.fixture
def value(spark):
    """Evaluate one column on literal inputs."""

    def evaluate(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return evaluate
