import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plumbline.plans import build_session

    session = build_session(8, shuffle_partitions=4, app_name="plumbline-tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def long_profiles(spark):
    """Force the plan for profiles that do not fit one task."""
    spark.conf.set("spark.plumbline.rowsPerSplit", "12")
    yield
    spark.conf.unset("spark.plumbline.rowsPerSplit")
