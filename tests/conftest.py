import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from verification.fixtures import derived_tables  # noqa: E402
from verification.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=2)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return derived_tables(spark, SF_DIR)


@pytest.fixture
def settings(spark):
    """Set session settings for one test."""
    before = {}

    def change(values):
        for key, value in values.items():
            before.setdefault(key, spark.conf.get(key))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.set(key, value)
