import pytest
from oracle import connect, same

from ledgerlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows_are_those_of_the_sql(spark, con, name):
    same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_queries_without_sql_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert len(df.columns) == 25
    assert df.count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
