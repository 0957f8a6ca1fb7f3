"""Queries of this subpackage that have SQL, against it."""

import pytest

from driftpool.llm import catalog
from tests import oracle


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert oracle.compare(spark, catalog.QUERIES[name], catalog.SQL[name], oracle.connect(folder), folder) == ""
