import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from boardlake.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def value(spark):
    """Value of one column expression."""
    one = spark.range(1)

    def read(column):
        got = one.select(column.alias("x")).collect()[0][0]
        return got.asDict() if hasattr(got, "asDict") else got

    return read
