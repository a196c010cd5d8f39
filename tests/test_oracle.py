"""All registered queries against their SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
from checks import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    from checks.compare import compare, connection

    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    ok, text = compare(spark, connection(FOLDER), FOLDER, name, query, sql)
    assert ok and "TYPES" not in text, text


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["site", "average_confidence", "quality_score"]
    assert rows.count() > 0
