import pytest

import __spark_entry__ as entry
from oracle import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit()))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert spark_rows(entry.queries()[name](spark, SF)) == sql_rows(SF, entry.oracle_sql()[name])


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and {"category", "key", "rank"} <= set(df.columns)
