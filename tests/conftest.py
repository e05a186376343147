from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from tideblock.session import local_session

    session = local_session(4, "tests")
    yield session
    session.stop()


@pytest.fixture
def many_chunks(spark):
    """Keep every range partition apart, so that even small data crosses chunk borders."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)
