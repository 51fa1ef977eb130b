import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from distillery.session import get_spark

    s = get_spark("local[4]", 8, app="distillery-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_root(spark):
    from distillery.session import scratch_path

    return scratch_path(spark, "test")
