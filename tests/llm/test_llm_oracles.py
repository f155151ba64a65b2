"""The operators' queries against the SQL they register, on whole tables."""

import pytest
from oracle import spark_rows, sql_rows

from tidemark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(SF, queries.oracle_sql()[name])
