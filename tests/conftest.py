import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quayside.session import local_session

    return local_session("8", "tests")


@pytest.fixture(scope="session")
def tables(spark):
    from quayside.plans.registry import Tables

    return Tables(spark, FOLDER)
