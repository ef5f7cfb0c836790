"""Queries of the subpackage that SQL can express, against DuckDB on whole tables."""

import pytest
from compare import differences, oracle

from barwright.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_oracle(spark, name):
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    assert len(got) and differences(got, oracle(FOLDER).execute(queries.SQL[name]).df()) == []
