"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_matches_sql(spark, con, name):
    said, *_ = compare(spark, con, name, SF)
    assert said.startswith(("ok", "rows-only")), said


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
