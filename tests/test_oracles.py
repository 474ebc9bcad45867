"""Every query of the reference's own operators against its SQL, over whole tables."""

import os

import pytest

from sentrylake.plans.queries import ORACLES, QUERIES
from tests.compare import assert_same, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["page_id", "host", "registered", "brand", "score", "verdict"]
    assert df.count() > 0
    assert set(__spark_entry__.queries()) >= set(QUERIES)
