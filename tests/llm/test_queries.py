import os

import pytest

import __spark_entry__ as entry
from tests_support import duck, rows  # noqa: F401

DIR = "/root/testdata/sf0.001"
NAMES = [n for n in entry.queries() if n[0] == "p" and n[1].isdigit()]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck(DIR).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    if name.endswith("_found"):
        assert not got.duplicated().any()
