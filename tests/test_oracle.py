"""Every registered query against its checking SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_point
import compare
from skyledger.sources.records import read_objects

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    run, sql = entry_point.queries()[name], entry_point.oracle_sql()[name]
    assert compare.differences(spark, con, run, sql, SF_DIR) is None


def test_listing_has_every_table(spark):
    rows = read_objects(spark, SF_DIR, os.path.dirname(os.path.dirname(SF_DIR)), "*.parquet").collect()
    assert sorted(os.path.basename(r.object_key) for r in rows) == sorted(os.listdir(SF_DIR))
    assert all(r.file_size == os.path.getsize(f"{SF_DIR}/{os.path.basename(r.object_key)}") for r in rows)
    assert {r.upload_id for r in rows} == {"sf0.001"} and {r.reason for r in rows} == {None}


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
