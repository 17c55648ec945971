import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rankfit.session import local_session

    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def one(spark):
    """Value of a column expression on one text."""

    def run(expr, value, type_="string"):
        return spark.createDataFrame([(value,)], f"x {type_}").select(expr.alias("y")).first()[0]

    return run
