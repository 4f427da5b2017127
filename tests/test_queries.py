"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from gridmill.plans import catalog
from tests.compare import difference

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert difference(spark, FOLDER, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rank", "sample_id", "image_file", "html_file", "html_length"]
    assert df.count() == 20
