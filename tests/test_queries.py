"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables; the others run."""

import pytest
from compare import compare, connect

from quillstone import plans


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, data, con, name):
    said = compare(spark, con, name, plans.queries()[name], plans.oracle_sql().get(name), data)
    assert said.startswith(("same", "rows")), said
