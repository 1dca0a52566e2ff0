import os

import pytest

import __spark_entry__ as entry
from compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in entry.queries()])
def test_query_equals_sql(spark, name):
    assert ": equal" in compare(spark, SF, name, entry.queries()[name], entry.oracle_sql()[name])


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "p4_found" in entry.queries()
