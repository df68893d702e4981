import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import fixtures  # noqa: E402


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(fixtures.rows(), fixtures.COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], fixtures.COLUMNS)
