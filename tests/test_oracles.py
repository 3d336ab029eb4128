"""Every registered query against its SQL on the small tables."""

import pytest

import oracle
from ledgerlens.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    assert oracle.differences(got, con.execute(catalog.SQL[name]).df()) == ""


def test_flagship_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
