from __future__ import annotations

import os

import pytest

from riskframe.session import local

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local(int(os.environ.get("TEST_CPUS", "4")), "3g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
