"""Every registered query runs; those with SQL are compared with DuckDB on the smallest tables."""

import glob
import os

import pytest
from tests_support import duck, rows

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit())]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.mark.parametrize("name", CORE)
def test_query(spark, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = duck(DIR).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_core_does_not_import_the_optional_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/tessera/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "tessera.llm" not in open(path, encoding="utf-8").read(), path


def test_read_around_takes_every_numbered_message_as_a_centre(spark):
    m = spark.read.parquet(f"{DIR}/history_messages.parquet").where("sequence IS NOT NULL AND message_id IS NOT NULL AND conversation_id IS NOT NULL")
    got = {r[0] for r in entry.queries()["read_around_all"](spark, DIR).select("center").distinct().collect()}
    assert got == {r[0] for r in m.select("message_id").distinct().collect()}
